"""Identifier boundaries and the positional index against plain scans."""

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import content


def goes_on(c, script):
    """Whether a character goes on a name, by Python's own tables."""
    if not script:
        return ("_" + c).isidentifier()
    extra = "\u2118\u212e\u309b\u309c\u00b7\u0387\u19da\u30fb\uff65$\u200c\u200d"
    return c != "\u2e2f" and (unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Nd", "Pc") or c in extra or "\u1369" <= c <= "\u1371")


def test_name_characters_are_those_of_unicode(spark):
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = spark.range(sys.maxunicode + 1).where("id NOT BETWEEN 55296 AND 57343").select(F.col("id"), F.decode(F.lpad(F.to_binary(F.hex("id"), F.lit("hex")), 4, b"\0"), "UTF-32").alias("c"))
    got = rows.select("id", F.regexp_like("c", F.lit(f"^{content.name_class()}$")).alias("name"), F.regexp_like("c", F.lit(f"^{content.name_class(True)}$")).alias("script")).toPandas()
    assert len(got) == len(codes)
    for script, column in ((False, "name"), (True, "script")):
        differ = [c for c, g in zip(got.id, got[column]) if bool(g) != goes_on(chr(c), script)]
        # the JVM's Unicode is older: only characters that it does not know yet may differ
        assert all(unicodedata.category(chr(c)) != "Cn" for c in differ) and len(differ) < 6000 and not any(c < 0x870 for c in differ)


def scan(text, identifier, script):
    candidate = identifier.strip(X.QUOTES)
    if "." in candidate:
        found, low, dot = [candidate], text, True
    else:
        words = re.findall("[a-z][a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", candidate)).lower())
        words = [w for w in words if w not in X.GENERIC_TERMS]
        found = [v for v in {candidate.lower(), "_".join(words), "".join(words)} if len(v) >= 3]
        low, dot = text.lower(), False
    for v in found:
        for m in re.finditer(re.escape(v), low):
            around = [low[m.start() - 1] if m.start() else "", low[m.end()] if m.end() < len(low) else ""]
            if not any(c and (goes_on(c, script) or (dot and c == ".")) for c in around):
                return True
    return False


FILES = [
    ("r", "a.py", "import x\n\nParseHeader = 1\nmod.load(y)\nself.mod.load2"),
    ("r", "b.ts", "const $parse_header = 1; // parse_header\u200d\nmod.load.x()\nother(parse_header)"),
    ("r", "c.py", "$parse_header\r\néparse_header parse_headeré\x85parseheader\u00b7\x0bMOD.LOAD"),
    ("r", "d.py", "nothing here \x00 parse_header"),
    ("r", "e.py", None),
    ("r", "f.py", "x.mod.load mod.load. (mod.load)\u2028reparsing headers__ parse_header"),
    ("s", "a.py", "parse_header"),
    ("r", "g.py", "parse_header" + " " * 1_000_000),
]
ISSUES = [
    (1, "r", ["parse_header", "mod.load"], ["`Lone`"], ["parse", "header", "load", "par", "ing"]),
    (2, "r", ["mod.load", "load2"], ["a.load2"], ["pars", "dhea"]),
    (3, "s", ["ParseHeader"], [], ["rse"]),
    (4, "r", [], [], []),
]


def test_hits_equal_a_scan_of_each_file_for_each_issue(spark):
    files = spark.createDataFrame(FILES, "repository string, path string, content string")
    issues = spark.createDataFrame(ISSUES, "issue_id long, repository string, identifiers array<string>, explicit_identifiers array<string>, content_terms array<string>")
    want = set()
    for i, repository, ids, explicit, terms in ISSUES:
        bare = {x for x in [*ids, *explicit] if "." not in x}
        asked = bare | {x for x in [*ids, *explicit] if "." in x and x.rsplit(".", 1)[-1] not in bare}
        for r, path, text in FILES:
            if r != repository or text is None or "\0" in text or len(text) > 1_000_000:
                continue
            hits = sorted(x for x in asked if scan(text, x, path.endswith(".ts")))
            words = sorted(w for w in terms if len(w) >= 4 and w in text.lower())
            line = next((n for n, s in enumerate(text.splitlines(), 1) if any(scan(s, x, path.endswith(".ts")) for x in hits)), None)
            if hits or words:
                want.add((i, path, tuple(hits), tuple(words), line))
    found = content.content_hits(issues, files)
    assert {(r.issue_id, r.path, tuple(r.identifiers), tuple(r.words), r.line) for r in found.collect()} == want and len(want) >= 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_texts_hold_needles_of_any_length(spark):
    needles = ["ab", "abc", "abcd", "abcde", "zz"]
    texts = ["ab", "xabcx", "abcde", "0abcdef", "z", ""]
    found = content.holding(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"), (2, 3, 4))
    assert {tuple(r) for r in found.collect()} == {(n, t) for n in needles for t in texts if n in t}
