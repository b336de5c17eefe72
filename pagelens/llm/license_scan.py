"""Operator 13: license scan as an exact set-similarity join of text blocks with license templates.

Words: A-Z lower-cased, runs of digits, letters a-z and non-ASCII characters. A template of m words belongs to the scale
s, the least power of two >= max(8, m); a document's blocks of that scale are its words [k * s, k * s + 2 * s), so any s
consecutive words lie whole in a block. A block meets a template when it holds at least ``need`` = ceil(threshold *
size) of the template's ``size`` distinct words. The join finds every such pair:

* one pass over the texts keeps, of every block, the words that any template of its scale has (no other word can count),
  and of these blocks only those with at least the least ``need`` of the scale (length filter);
* words are ranked by the number of blocks that hold them over all documents, rarest first, ties by the word;
* of a block with b words the first b - need + 1 ranks, of a template the first size - need + 1 (prefix filter): sets
  with ``need`` common words have a common one in both prefixes. They are joined on (scale, rank);
* a pair's first common word at place i of the block and j of the template leaves at most 1 + min(b - i, size - j) - 1
  common ones (positional filter); what stays is counted.

Templates are a table (label, text) of at most TEMPLATE_BYTES of text, which is checked; their words and prefixes are all
that is sent to the tasks. Texts never leave their scan. Frequent words are counted by partial sums, and the join's rows are
keyed by document row, so neither a license in a third of all documents nor a long document gathers in one task beyond
that document's own blocks.

Null, empty and wordless texts have zero counts, empty labels and score 0. Rows are treated one by one: null and repeated doc_ids keep
their rows. Other columns are not read. A null label or a template without words is ignored; an empty template table leaves the base labels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

TEMPLATE_BYTES = 32_000_000
THRESHOLD = 0.9
LEAST_SCALE = 8
WORDS = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128))).translate(C.LOWER)

#: Phrases of the base labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Usual notices of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
                 "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
            "Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def scale_of(n: int) -> int:
    return max(LEAST_SCALE, 1 << (n - 1).bit_length())


def read_templates(templates: DataFrame, threshold: float) -> list[tuple[str, int, int, list[bytes]]]:
    """(label, scale, need, distinct words) of every template; the table's size is checked first."""
    used = templates.select("label", F.col("text").cast("binary").alias("text")).where("label is not null and text is not null")
    size = used.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes: more than {TEMPLATE_BYTES}")
    out = []
    for label, text in sorted({(r["label"], bytes(r["text"])) for r in used.collect()}):
        w = words_of(text)
        if w:
            distinct = sorted(set(w))
            out.append((label, scale_of(len(w)), math.ceil(round(threshold * len(distinct), 9)), distinct))
    return out


def _scan(vocabulary: dict[bytes, int], phrases: list[tuple[list[int], str]], scales: list[tuple[int, int, list[int]]]):
    """Per row: base places, and the blocks with at least the least need of their scale."""
    def find(ids: np.ndarray, of: np.ndarray, phrase: list[int]) -> np.ndarray:
        n = len(ids) - len(phrase) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        ok = of[:n] == of[len(phrase) - 1:]
        for k, w in enumerate(phrase):
            ok &= ids[k:k + n] == w
        return np.flatnonzero(ok)

    def run(batches):
        look = vocabulary.get
        chosen = [(s, need, np.isin(np.arange(len(vocabulary)), members)) for s, need, members in scales]
        for batch in C.slices(batches):
            split = [words_of(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(w) for w in split], np.int64)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.fromiter((look(x, -1) for w in split for x in w), np.int64, int(begin[-1]))
            of = np.repeat(np.arange(len(split)), sizes)
            place = np.arange(len(ids)) - begin[of]
            n_base, first, last = np.zeros(len(split), np.int64), np.full(len(split), -1), np.full(len(split), -1)
            labels: list[set[str]] = [set() for _ in split]
            for phrase, label in phrases:
                at = find(ids, of, phrase)
                for d, p in zip(of[at].tolist(), place[at].tolist()):
                    n_base[d] += 1
                    first[d] = p if first[d] < 0 else min(first[d], p)
                    last[d] = max(last[d], p)
                    labels[d].add(label)
            blocks: list[list[dict]] = [[] for _ in split]
            for scale, need, member in chosen:
                at = np.flatnonzero((ids >= 0) & member[ids])
                block = place[at] // scale
                # (row, block, word) of the two blocks that hold each place
                rows = np.concatenate([np.stack([of[at], b, ids[at]])[:, b >= 0] for b in (block, block - 1)], axis=1)
                rows = np.unique(rows, axis=1)
                if not rows.shape[1]:
                    continue
                edge = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
                count = np.diff(np.concatenate([edge, [rows.shape[1]]]))
                for e in np.flatnonzero(count >= need).tolist():
                    a, b = int(edge[e]), int(edge[e] + count[e])
                    blocks[int(rows[0, a])].append({"scale": scale, "start": int(rows[1, a]) * scale, "words": rows[2, a:b].tolist()})
            none = first < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(n_base), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                 pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                 pa.array(blocks, pa.list_(pa.struct([("scale", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int32()))])))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])
    return run


def license_scan(docs: DataFrame, templates: DataFrame, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word (of the phrases' places), base_labels and labels
    (sorted, comma-joined), score (largest share of a template's distinct words found together, 1 where a phrase stands, else 0) and found:
    array of (label, start, length, share) of the blocks that meet a template, by start."""
    spark = docs.sparkSession
    known = read_templates(templates, threshold)
    base = [([w for w in words_of(p.encode())], label) for p, label in phrases]
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in known for w in t[3]} | {w for p, _ in base for w in p}))}
    scales = [(s, min(t[2] for t in known if t[1] == s), sorted({vocabulary[w] for t in known if t[1] == s for w in t[3]})) for s in sorted({t[1] for t in known})]
    source = C.texts(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, "
              "blocks array<struct<scale:int,start:long,words:array<int>>>")
    scan = source.mapInArrow(_scan(vocabulary, [([vocabulary[w] for w in p], label) for p, label in base if p], scales), schema)
    rows = C.stage(scan.withColumn("row", F.monotonically_increasing_id()), "licenses")

    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    counts = dict(blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect())  # at most the templates' words
    order = sorted(range(len(vocabulary)), key=lambda w: (counts.get(w, 0), w))
    rank = [0] * len(vocabulary)
    for i, w in enumerate(order):
        rank[w] = i
    entries = []
    for t, (label, scale, need, distinct) in enumerate(known):
        ranks = sorted(rank[vocabulary[w]] for w in distinct)
        entries += [(scale, r, t, label, need, j, ranks) for j, r in enumerate(ranks[:len(ranks) - need + 1])]
    index = spark.createDataFrame(entries, "scale int, rank int, template int, label string, need int, t_place int, t_ranks array<int>")
    least = F.create_map(*[F.lit(x) for s, need, _ in scales for x in (s, need)]) if scales else F.create_map(F.lit(0), F.lit(0))
    ranked = blocks.withColumn("ranks", F.array_sort(F.transform("words", lambda w: F.get(F.array(*map(F.lit, rank)), w))))
    prefix = F.slice("ranks", F.lit(1), F.size("ranks") - least[F.col("scale")] + 1)
    met = (ranked.select("row", "scale", "start", "ranks", F.posexplode(prefix).alias("place", "rank"))
           .join(F.broadcast(index), ["scale", "rank"])  # bounded by TEMPLATE_BYTES
           .groupBy("row", "scale", "start", "template")
           .agg(F.min_by(F.struct("ranks", "label", "need", "t_ranks", "t_place"), "place").alias("m"), F.min("place").alias("place"))
           .where(F.least(F.size("m.ranks") - F.col("place"), F.size("m.t_ranks") - F.col("m.t_place")) >= F.col("m.need"))
           .withColumn("common", F.size(F.array_intersect("m.ranks", "m.t_ranks")))
           .where(F.col("common") >= F.col("m.need"))
           .withColumn("share", F.col("common") / F.size("m.t_ranks")))
    found = met.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", F.col("m.label").alias("label"), (2 * F.col("scale")).alias("length"), "share"))).alias("found"),
        F.collect_set("m.label").alias("more"), F.max("share").alias("most"))
    out = rows.drop("blocks").join(found, "row", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", empty))), ",").alias("labels"),
        F.greatest(F.coalesce("most", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"), "found")
