import random
import zlib

import numpy as np
import public_tokenizers
import tokenizers

from spanlake.llm import packing_tiers, token_counts
from tests.llm.helpers import LONG, TEXTS, no_docs, odd_docs

ODD = ["", "aaaaaaaaaaaa", "<|endoftext|> a <|STARTOFTEXT|><|startoftext|>x", "ΑΣ ΑΣΑ İ", "'S it'S don'T WE'LL", "á̧ \r\n x\x1cy\x85z ", "haha" * 200, "Ᲊx", "日本語" * 300, LONG]


def drawn(n, alphabet):
    rnd = random.Random(3)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(n)]


def test_counts_equal_the_library():
    own = token_counts.counter("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + drawn(200, "abcdeé <|>\'s日Σ͸Z09_-\n") + drawn(1, "ab" * 5000)
    assert own.count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_code_point_is_cut_as_the_library_does():
    own = token_counts.counter("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    points = [c for c in range(1, 0x32400) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}." for c in points[::7]]
    assert own.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_merging_keeps_a_long_word_linear_enough():
    own = token_counts.counter("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word = "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(50_000))
    assert own.count([word]) == [len(lib.encode(word, add_special_tokens=False).ids)]


def test_count_rows(spark):
    got = token_counts.token_counts(odd_docs(spark)).collect()
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((d if d is not None else -1, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, _, _ in TEXTS)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(no_docs(spark)).count() == 0


def test_fast_ids_equal_the_library():
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    points = [c for c in range(1, 0x32400) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}." for c in points[::5]] + ODD
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing_tiers.token_ids(t).tolist() == [*e.ids, 0]


def test_plans_are_full_and_lose_nothing():
    rnd = random.Random(5)
    sizes = [1, 5, 100, 127, 128, 129, 500, 512, 513, 700, 1023, 1024, 1025, 3000]
    for _ in range(200):
        lengths = np.array([rnd.choice([*sizes, rnd.randint(1, 2000)]) for _ in range(rnd.randint(1, 40))])
        p = packing_tiers.plan(lengths, (128, 256, 512, 1024))
        for d, n in enumerate(lengths):
            q = p[p[:, 0] == d]
            q = q[np.argsort(q[:, 1])]
            assert q[0, 1] == 0 and (q[1:, 1] == q[:-1, 1] + q[:-1, 2]).all() and q[-1, 1] + q[-1, 2] == n
        for s in range(p[:, 3].max() + 1):
            q = p[p[:, 3] == s]
            q = q[np.argsort(q[:, 4])]
            assert q[0, 4] == 0 and (q[1:, 4] == q[:-1, 4] + q[:-1, 2]).all() and (q[:, 2] > 0).all()
            total = int(q[:, 2].sum())
            assert total <= 1024 and total & (total - 1) == 0


def test_long_windows_are_filled_from_shorter_tiers():
    p = packing_tiers.plan(np.array([900, 100, 300]), (128, 256, 512, 1024))
    window = p[p[:, 3] == p[p[:, 0] == 0][0, 3]]
    assert window[:, 2].sum() == 1024 and {0, 1} <= set(window[:, 0])


def test_step_groups_hold_nearly_equal_tokens():
    sizes = np.random.default_rng(1).choice([1024, 512, 256, 128], 640)
    g = packing_tiers.step_groups(sizes, 64)
    loads = np.bincount(g, sizes)
    assert len(loads) == 10 and loads.max() - loads.min() <= 1024


def test_pieces_hold_every_id_once(spark):
    rows = packing_tiers.pack(odd_docs(spark), group_bytes=20_000).toPandas()
    texts = {d: t for d, t, _, _ in TEXTS if d != 7}
    for d, t in texts.items():
        ids = packing_tiers.token_ids(t)
        own = rows[rows.doc_id.isna() if d is None else rows.doc_id == d].sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    assert rows[rows.doc_id == 7].length.sum() == 2 * len(packing_tiers.token_ids(TEXTS[0][1]))
    for _, q in rows.sort_values("offset").groupby("sequence_id"):
        assert (q.offset == q.length.cumsum() - q.length).all() and q.length.sum() == q.sequence_tokens.iloc[0] <= 1024
    assert packing_tiers.pack(no_docs(spark)).count() == 0


def test_long_runs_of_white_space_have_the_ids_of_the_library():
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" + "\t" * 1_000_000 + "b", "x" + "\u3000 \x85\r\n" * 250_000 + "y", ("w" + " " * 19_999) * 60):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert packing_tiers.token_ids(text).tolist() == [*ids, 0]


def test_pieces_of_documents_larger_than_a_group(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(n))) for i, n in enumerate((9000, 12_000, 40, 3))] + [(9, " " * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing_tiers.pack(df, group_bytes=20_000).collect()
    for doc_id, text in docs:
        ids = packing_tiers.token_ids(text)
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
