"""Operator 3's encoder: ids as the library gives them, from bounded memory whatever the number of new pieces."""

import random
import struct
import tracemalloc

import public_tokenizers

from quarryline.llm import tokenfile


def test_many_new_pieces_are_encoded_in_runs():
    encoder, rng = tokenfile.Encoder(public_tokenizers.path(tokenfile.VOCABULARY)), random.Random(3)
    word = lambda: "".join(rng.choice("aeinrstéß日.") for _ in range(rng.randrange(5, 12)))
    often = [word() for _ in range(50)]
    texts = [" ".join([*(word() for _ in range(300)), *rng.choices(often, k=100)]) for _ in range(300)]
    odd = [None, "", " ", "  two  blanks ", "tab\tand\nline", "x<|endoftext|>y", " no break", "a" * 3000, " ".join(often * 1500)]
    want = [struct.pack(f"<{len(x.ids) + 1}I", *x.ids, 2) for x in encoder.model.encode_batch([t or "" for t in texts + odd], add_special_tokens=False)]

    class Model:
        most = 0

        def __getattr__(self, name):
            return getattr(model, name)

        def encode_batch_fast(self, given, **how):
            Model.most = max(Model.most, sum(map(len, given)))
            return model.encode_batch_fast(given, **how)

    model, encoder.model = encoder.model, Model()
    tracemalloc.start()
    try:
        first = encoder.ids(texts)
        peak = tracemalloc.get_traced_memory()[1] - sum(map(len, first))
    finally:
        tracemalloc.stop()
    assert first == want[:300] == encoder.ids(texts)
    # 90,000 pieces occur once, 800 KB of text; 50 are worth remembering
    assert peak < 16 << 20, peak
    assert Model.most < 100_000 and len(encoder.known) < 1000
    assert encoder.ids(texts[:20] + odd) == want[:20] + want[300:]
    assert encoder.ids([]) == []
