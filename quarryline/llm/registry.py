"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quarryline.llm import decontaminate, erratatrie, exactdedup, language, linkgraph, mixing, pii, prefixfree, quality, simhash, tokenfile, warc, whitening


def queries() -> dict:
    return {
        "op1_warc_fixity": warc.op1_warc_fixity,
        "op2_url_linkgraph": linkgraph.op2_url_linkgraph,
        "op3_token_frames": tokenfile.op3_token_frames,
        "op4_quality_knn": quality.op4_quality_knn,
        "op5_language_id": language.op5_language_id,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_pii_boosting": pii.op7_pii_boosting,
        "op8_exact_dedup": exactdedup.op8_exact_dedup,
        "op9_simhash_golay": simhash.op9_simhash_golay,
        "op10_mixing": mixing.op10_mixing,
        "op11_whitening": whitening.op11_whitening,
        "op12_prefix_free": prefixfree.op12_prefix_free,
        "op13_errata_trie": erratatrie.op13_errata_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_fixity": warc.OP1_SQL,
        "op2_url_linkgraph": linkgraph.OP2_SQL,
        "op6_decontaminate": decontaminate.OP6_SQL,
        "op8_exact_dedup": exactdedup.OP8_SQL,
    }
