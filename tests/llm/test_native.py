from __future__ import annotations

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from docloom.llm import chat_format, license_scan, threshold_sketch

MASK = 2**64 - 1


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def combine(*longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed & MASK)
    return signed(seed)


def brute_sketch(text, n=5, fraction=1 / 8):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return []
    if len(words) < n:
        total = 0
        for w in words:
            total = combine(total, w)
        hashes = [total]
    else:
        two = [combine(a, b) for a, b in zip(words, words[1:], strict=False)]
        four = [combine(a, b) for a, b in zip(two, two[2:], strict=False)]
        hashes = [combine(a, b) for a, b in zip(four, four[1:], strict=False)]
    below = sorted({h for h in hashes if h < -(2**63) + int(2**64 * fraction)})
    return below or [min(hashes)]


def test_sketches_by_brute_force(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["a", "bé", "c", "d", "e", "f"]) for _ in range(draw.choice([0, 1, 4, 5, 6, 50, 300]))) for _ in range(60)] + [None, " \t\n"]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id // 3: r for r in threshold_sketch.fingerprint(docs, rows_per_task=7).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].edited == edited and got[i].n_chars == len(t)
        assert got[i].sketch == brute_sketch(t) and got[i].edited_sketch == brute_sketch(edited) and got[i].next_sketch == brute_sketch(after)


def test_merge_and_containment(spark):
    words = [str(i) for i in range(2000)]
    row = spark.createDataFrame([(" ".join(words), " ".join(words[:400]))], "a string, b string").select(threshold_sketch.sketch(F.col("a")).alias("a"), threshold_sketch.sketch(F.col("b")).alias("b"))
    got = row.select(threshold_sketch.containment(F.col("b"), F.col("a")).alias("x"), threshold_sketch.containment(F.col("a"), F.col("b")).alias("y"), (threshold_sketch.merge(F.col("a"), F.col("b")) == F.col("a")).alias("m")).first()
    assert got.x == 1.0 and 0.12 < got.y < 0.28 and got.m


def test_sketch_edge_cases(spark):
    rows = [(None, "x y z"), (1, "same"), (1, "same"), (2, None)]
    got = threshold_sketch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_chars for r in got] == [5, 4, 4, 0] and got[1].edited == "sams" and got[3].edited == ""
    assert threshold_sketch.fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licences(spark):
    said = [
        "Released under the MIT License.", "mit. license", "x Apache License, Version 2.0 and the MIT license", "GNU General Public License, version 3",
        "This work is licensed under the GNU General Public License, version 3.", "general public licence", "mit", "", None, "é " * 3000 + "Licensed under CC BY-NC 4.0",
        "license " * 2000, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in license_scan.scan(docs).where("n_words >= 0").collect()}
    assert [got[i].base_labels for i in range(9)] == [["mit"], ["mit"], ["apache", "mit"], ["gpl"], ["gpl"], [], [], [], []]
    assert "gpl-3.0" in got[4].labels and got[4].score == 1.0 and got[9].labels == ["cc-by-nc-4.0"] and got[11].labels == ["mit-text"] and got[10].labels == []
    assert [(p.start, p.label) for p in got[2].places] == [(1, "apache"), (8, "mit")] and got[8].n_words == 0
    for i, t in enumerate(said):  # the base by brute force
        words = [w for w in re.split(license_scan.SPLIT, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        want = sorted((k, label) for phrase, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert [(p.start, p.label) for p in got[i].places] == want and got[i].n_words == len(words)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_names_and_versions_of_licences(spark):
    said = {
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1": ["gpl", "lgpl-2.1"],
        "Apache License v2.0": ["apache", "apache-2.0"],
        "Mozilla Public License Version 2.0": ["mpl-2.0"],
        "SPDX-License-Identifier: BSD-3-Clause": ["bsd-3-clause"],
        "SPDX-License-Identifier: GPL-2.0-or-later": ["gpl-2.0"],
        "GNU General Public License version 2": ["gpl", "gpl-2.0"],
        "GNU Affero General Public License version 3": ["agpl", "gpl"],
    }
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r.text: r.labels for r in license_scan.scan(docs).collect()}
    assert {t: [x for x in got[t] if x not in ("lgpl",)] for t in said} == said


def test_licences_of_a_file_with_several(spark):
    """All templates whose key phrase stands in a file are found, with the best share of any of their places."""
    texts = [t for _, t, _ in license_scan.TEMPLATES]
    said = [f"{texts[1]}. Licensed under the Apache License, Version 2.0. Licensed under CC BY 4.0", ". ".join(texts), " x ".join(k for _, _, k in license_scan.TEMPLATES), "mit license. x Released under the MIT license", "cc by sa 4 0 cc by cc by 4 0"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for most in (4, 1):
        got = {r.doc_id: r for r in license_scan.scan(docs, rare_words=most).collect()}
        for i, t in enumerate(said):
            words = [w for w in re.split(license_scan.SPLIT, t.lower()) if w]
            labels, score = set(got[i].base_labels), 0.0
            for label, text, phrase in license_scan.TEMPLATES:
                at = len(text[: f" {text} ".index(f" {phrase} ")].split())
                for k in range(len(words)):
                    if words[k : k + len(phrase.split())] == phrase.split():
                        labels.add(label)
                        score = max(score, sum(0 <= k - at + j < len(words) and words[k - at + j] == x for j, x in enumerate(text.split())) / len(text.split()))
            assert got[i].labels == sorted(labels) and abs(got[i].score - score) < 1e-12
        assert {"mit-text", "apache-2.0", "cc-by-4.0"} <= set(got[0].labels) and got[3].score == 1.0


def test_chat_round_trip(spark):
    draw = random.Random(8)
    bits = ["<|im_end|>", "<|", "\\", "|>", "\n", "<\\|", "<\\n|", "é", "ok", "<|im_start|>assistant\n"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "a\nb", None]), draw.choice([None, "".join(draw.choice(bits) for _ in range(draw.randint(0, 8)))])) for c in range(40) for t in range(draw.randint(1, 6))]
    rows += [(None, None, "user", "x"), (99, 1, "assistant", "twice"), (99, 1, "assistant", "twice")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    examples = chat_format.prefix_targets(docs)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    whole = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert whole[c].n_turns == len(turns) and whole[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert whole[c].loss_chars == len(loss) and whole[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        made = sum(r == "assistant" for r, _ in turns) + (turns[-1][0] != "assistant")
        assert examples.where(F.col("conv_id").eqNullSafe(c)).count() == made
    assert chat_format.prefix_targets(docs.limit(0)).count() == 0


def test_every_template_of_one_text_is_found_and_long_texts_end(spark):
    """All templates in one text; one word 100,000 times; repeated rows; each label by brute force."""
    every = " ; ".join(said for _, said, _ in license_scan.TEMPLATES)
    rows = [(1, every), (2, "license " * 100_000), (3, "mit license"), (3, "mit license"), (4, "The MIT  Licence or cc by 4"), (5, "x " * 50_000 + "cc by 4 0 mozilla public license v 2 0")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))).collect()
    for r in got:
        said = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", dict(rows)[r.doc_id].lower()))
        want = {label for label, _, key in license_scan.TEMPLATES if f" {key} " in f" {said} "} | {label for phrase, label in license_scan.PHRASES if f" {phrase} " in f" {said} "}
        assert r.labels == sorted(want), r.doc_id
    assert len(got) == len(rows) and {r.n_words for r in got if r.doc_id == 2} == {100_000}
