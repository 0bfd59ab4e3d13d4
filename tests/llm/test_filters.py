import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spanlake.llm import language_id, license_rules, quality_llr
from tests.llm.helpers import LONG, TEXTS, clashing, no_docs, odd_docs

BLANK = r"[^\x20\x09-\x0D]+"


def documents(spark, sf):
    return clashing(spark.read.parquet(f"{sf}/documents.parquet"))


# language ID


def test_language_is_told_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    got = language_id.identify(docs, language_id.language_model(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98
    assert got.rejected.mean() < 0.01 and got.score.between(0, 1).all()


def test_labels_of_held_out_rows_teach_nothing(spark, sf):
    docs = documents(spark, sf)
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language_id.language_model(docs), language_id.language_model(other)
    assert a.languages == b.languages and np.array_equal(a.table, b.table)


def test_odd_texts_are_unknown(spark, sf):
    model = language_id.language_model(documents(spark, sf))
    rows = {r.doc_id: r for r in language_id.identify(odd_docs(spark), model).collect()}
    for d in (2, 3, 4, 8):
        assert (rows[d].lang_pred, rows[d].score, rows[d].rejected) == ("und", 0.0, True)
    assert rows[1].lang_pred in model.languages and rows[5].lang_pred in model.languages
    assert language_id.identify(no_docs(spark), model).count() == 0
    nothing = language_id.language_model(no_docs(spark))
    assert {r.lang_pred for r in language_id.identify(odd_docs(spark), nothing).collect()} == {"und"}


def test_calibration_bounds_false_rejections():
    draw = np.random.default_rng(1)
    y = draw.integers(0, 3, 3000)
    logits = draw.normal(0, 1, (3000, 3))
    logits[np.arange(3000), y] += 2.5
    temperature, bound = language_id.calibrate(logits * 4, y, 0.01)
    p = language_id.softmax(logits * 4 / temperature)
    right = p.argmax(1) == y
    # classes of unit variance 2.5 apart have log odds of 2.5 times the value
    assert abs(temperature - 4 / 2.5) < 0.2 and abs(p.max(1).mean() - right.mean()) < 0.03
    assert (p.max(1)[right] < bound).mean() <= 0.01


# quality rules


def base_columns(text):
    text = text or ""
    w = re.findall(BLANK, text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + j for i, k in enumerate(windows) if often[k] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed(parts, seed=42):
    """Spark's xxhash64 over strings and longs."""
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def grams(text):
    h = [hashed([w.encode()]) for w in re.findall(BLANK, text or "")]
    mark = (2).to_bytes(4, "little")

    def pair(i):
        parts = [h[i], *h[i + 1 : i + 2]]
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.to_bytes(8, "little", signed=True), seed)
        return seed

    return h, [hashed_int(2, pair(i)) for i in range(len(h))], mark


def hashed_int(x, seed):
    """xxhash64 of a 32-bit integer as Spark takes it: four bytes."""
    return signed(xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed))


def test_verdicts_equal_brute_force(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality_llr.judge(docs, labels, 0.99).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1} & set(texts)
    held = {d for d in good if hashed([d]) % quality_llr.HELD_BACK == 0}
    features = {d: [x % quality_llr.BUCKETS for x in (lambda h, p, _: h + p)(*grams(t))] for d, t in texts.items()}
    raw, trusted = Counter(), Counter()
    for d, f in features.items():
        raw.update(f)
        if d in good - held:
            trusted.update(f)
    a, b = sum(trusted.values()) + quality_llr.BUCKETS, sum(raw.values()) + quality_llr.BUCKETS
    ratio = {k: math.log((trusted[k] + 1) / a) - math.log((raw[k] + 1) / b) for k in raw}
    score = {d: sum(ratio[k] for k in f) / max(1, len(f)) for d, f in features.items()}
    steps = sorted(math.floor(score[d] * quality_llr.STEP) for d in held if got[d].n_words >= quality_llr.MIN_WORDS)
    bound = steps[int(0.01 * len(steps))] / quality_llr.STEP
    for d, t in texts.items():
        r, n = got[d], base_columns(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert r.base_failed == failed and abs(r.score - score[d]) < 1e-9
        assert r.kept == (not failed and r.score >= bound)


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_llr.judge(documents(spark, sf), labels).join(labels, "doc_id").where(~F.col("base_failed"))
    kept = {r.quality: (r.n, r.k) for r in got.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()}
    assert kept[1][1] >= 0.99 * kept[1][0] and kept[0][1] <= 0.2 * kept[0][0]


def test_odd_texts_are_judged(spark):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("quality > 1")):
        rows = quality_llr.judge(odd_docs(spark), known).collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            text = next(t for d, t, _, _ in TEXTS if d == r.doc_id)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_columns(text)
            assert r.kept is False
        assert quality_llr.judge(no_docs(spark), known).count() == 0


# license scan


def brute_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(license_rules.WORD, low)
    at, base = [], set()
    for phrase, label in license_rules.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    hits = []
    if any(s in low for s in license_rules.STEMS):
        for i, (p, label, _, pattern) in enumerate(license_rules.rules()):
            hits += [(m.start(), -m.end(), p, i, label) for m in re.finditer(pattern, low, re.ASCII)]
    hits.sort()
    kept = [h for n, h in enumerate(hits) if not any(g[1] <= h[1] and g[2] <= h[2] for g in hits[:n])]
    score = license_rules.SCORE[min(h[2] for h in kept)] if kept else 0.5 if base else 0.0
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[4] for h in kept})), score


SCANNED = [
    "Licensed under CC BY-NC 4.0. All rights reserved.",
    "mit license, MIT-License; Apache   License mit license",
    "SPDX-License-Identifier: GPL-2.0-or-later\nThis is under the GNU Lesser General Public License and the new BSD license",
    "see https://www.GNU.org/licenses/agpl and creativecommons.org/licenses/by-sa/4.0 cc by cc-by-sa",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "éapache license İ KIT license ſ Kelvin mit licence",
    "This program is free software: you can redistribute it and/or modify it. Share-Alike! sharealike",
    "You may not use this file except in compliance with the Licence. No part of it may be reproduced without prior written permission",
    "the mit license " * 1500,
    LONG + " MIT License",
    *[t for _, t, _, _ in TEXTS],
]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(SCANNED)), "doc_id long, text string")
    for r in license_rules.scan(clashing(df)).collect():
        want = brute_scan(SCANNED[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want, SCANNED[r.doc_id][:60]
    assert license_rules.scan(no_docs(spark)).count() == 0
    assert license_rules.scan(odd_docs(spark)).count() == len(TEXTS)


def test_scan_of_the_tables(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in license_rules.scan(documents(spark, sf)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_scan(texts[r.doc_id])


def test_rules_are_gated_by_what_they_match():
    for _, label, word, pattern in license_rules.rules():
        assert re.compile(pattern) and label
        assert word == "" or word in pattern.replace("\\", "") or word in pattern
    assert len(license_rules.rules()) > 200


def least_text(tree):
    """A shortest text that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            out += {"LITERAL": lambda v: chr(v), "CATEGORY": lambda v: "1", "RANGE": lambda v: chr(v[0])}[str(arg[0][0])](arg[0][1])
        elif name == "MAX_REPEAT":
            out += least_text(arg[2]) * arg[0] if arg[0] else ""
        elif name == "SUBPATTERN":
            out += least_text(arg[-1])
        elif name == "BRANCH":
            out += least_text(arg[1][0])
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
    return out


def test_each_rule_fires_on_a_least_text_plain_and_wrapped(spark):
    some = license_rules.rules()
    plain = [least_text(re._parser.parse(x)).replace("\t", " ") for *_, x in some]
    texts = [t for p in plain for t in (p, p.replace(" ", "\n * "), p.replace(" ", "  \r\n\t// "))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    missed = [(some[r.doc_id // 3][1], texts[r.doc_id]) for r in license_rules.scan(df).collect() if some[r.doc_id // 3][1] not in r.labels.split(",")]
    assert not missed
    kept = {r.doc_id // 3: r.rules for r in license_rules.scan(df).collect() if r.doc_id % 3 == 1}
    # a rule's hit may lie inside a longer one of the same label
    assert all(some[i][1] in [some[k][1] for k in v] for i, v in kept.items())
    assert sum(some[i][3] in [some[k][3] for k in v] for i, v in kept.items()) > 0.9 * len(some)


def test_wrapped_clauses_and_later_versions(spark):
    texts = {
        1: "Redistribution and use in source and binary forms, with or without\nmodification, are permitted. All rights reserved",
        2: "# Permission to use, copy, modify, and distribute this software for any\n# purpose",
        3: "see https://www.latex-project.org/lppl.txt",
        4: "SPDX-License-Identifier: GPL-2.0+",
        5: "licenced under CC\nBY\n",
        6: "https://creativecommons.org/licenses/by/\nnext",
        7: " \t" * 20000 + "*/ " * 20000 + "GNU General\r\n\r\n ** Public  Licence",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_rules.scan(df).collect()}
    assert got == {1: "bsd,proprietary", 2: "isc", 3: "lppl", 4: "gpl", 5: "cc-by", 6: "cc-by", 7: "gpl"}


def test_notices_expressions_and_clauses_have_their_labels(spark):
    texts = {
        "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License": "agpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
        "Copyright (c) 2020. All rights reserved.\n\n * Redistribution and use in source and binary forms, with or without modification, are": "bsd",
        "please share alike with your friends": "",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache,mit",
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": "apache,bsd-3,mit",
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "gpl",
        "GNU GPL version 2": "gpl",
        "GPL v3": "gpl",
        "LGPLv2.1+": "lgpl",
        "this is not under the GPL": "not-gpl",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation": "boost",
        "Apache License, Version 2.0": "apache",
        "Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa",
        "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {list(texts)[r.doc_id]: r.labels for r in license_rules.scan(df).collect()}
    assert got == texts
    written = [x for _, _, _, x in license_rules.rules()]
    assert len(license_rules.NOTICES.strip().splitlines()) + len(license_rules.CLAUSES.strip().splitlines()) > 90 and len(written) == len(set(written))
