"""License scan by an exact set-similarity join.

Texts are cut into blocks, their lines. A block meets a template when it has
at least ``threshold`` of the template's distinct tokens. The join that finds
all such pairs is exact. Tokens are put in one global order, rarest in the
corpus first, and three filters discard pairs that cannot reach the overlap
``need = ceil(threshold * tokens)``:

* prefix: one of the template's first ``tokens - need + 1`` tokens must be in
  the block, and these are its rarest, so few blocks go on at all;
* length: a block with fewer than ``need`` template tokens cannot meet it;
* position: at a shared token, what both have left must suffice.

Only tokens that some template has can be shared, so a block is represented by
those alone. Pairs that pass are verified on the whole token sets.

A licence text may also be wrapped over lines. Such passages are runs of as
many tokens as the template has, repeated ones counted, that go over a line
break. The prefix filter is the same: only runs around a prefix token are
looked at, and all of these are verified.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-grant": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
THRESHOLD = 0.9
BLOCKS = r"\n"
TOKENS = "[a-z0-9]+"
#: Up to so many prefix tokens are looked for in a block before it is sent on; beyond, the join alone does. The result is the same.
LITERAL = 256
#: Rows of a template table that is still broadcast.
BROADCAST_ROWS = 200_000


def tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0)))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def needed(size: int, threshold: float) -> int:
    """The smallest overlap that is at least ``threshold`` of ``size``."""
    return max(1, math.ceil(Decimal(str(threshold)) * size))


def frequencies(texts: DataFrame, vocabulary: DataFrame, rows: int) -> DataFrame:
    """(token, n): occurrences in all of ``texts(t)`` of each token of ``vocabulary(token)``."""
    words = texts.select(F.explode_outer(F.regexp_extract_all(F.lower(F.col("t")), F.lit(TOKENS), F.lit(0))).alias("token"))
    return words.join(_small(vocabulary, rows), "token").groupBy("token").agg(F.count("*").alias("n"))


def _passages(blocks: list[str], anchors: dict[str, list[str]], shapes: dict[str, tuple[frozenset, int, int]]) -> Iterator[tuple[int, str, int, int]]:
    """(block_no, template, overlap, template_tokens) of the wrapped passages of one text, ``blocks`` in lower case."""
    words, lines = [], []
    for line, block in enumerate(blocks):
        found = re.findall(TOKENS, block)
        words += found
        lines += [line] * len(found)
    starts = defaultdict(set)
    for i, w in enumerate(words):
        for name in anchors.get(w, ()):
            starts[name].update(range(max(0, i - shapes[name][1] + 1), i + 1))
    for name in sorted(starts):
        own, length, need = shapes[name]
        met = []
        for start in starts[name]:
            both = len(own.intersection(words[start : start + length]))
            if both >= need:
                met.append((-both, start))
        kept: set[int] = set()
        for both, start in sorted(met):
            if any(k in kept for k in range(start - length + 1, start + length)):
                continue
            kept.add(start)
            shared = [lines[k] for k in range(start, min(start + length, len(words))) if words[k] in own]
            if shared[0] < shared[-1] and not any(len(own.intersection(re.findall(TOKENS, b))) >= need for b in blocks[shared[0] : shared[-1] + 1]):
                yield shared[0], name, -both, len(own)


def wrapped_passages(src: DataFrame, templates: dict[str, str], prefixes: dict[str, list[str]], needs: dict[str, int], block_pattern: str) -> DataFrame:
    """(doc_id, block_no, template, overlap, template_tokens) of ``src(doc_id, t)``: passages wrapped over blocks.

    ``prefixes``: templates by prefix token. Of passages of one template that
    overlap, the one that shares most tokens counts, the first of equals.
    ``block_no`` is the block of its first shared token. Where a single block
    of the passage meets the template, it is not reported again.
    """
    cut = {name: re.findall(TOKENS, templates[name].lower()) for name in needs}
    held = src.sparkSession.sparkContext.broadcast((prefixes, {name: (frozenset(own), len(own), needs[name]) for name, own in cut.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, shapes = held.value
        for batch in batches:
            at, rows = [], []
            for k, blocks in enumerate(batch.column("blocks").to_pylist()):
                for row in _passages(blocks, anchors, shapes):
                    at.append(k)
                    rows.append(row)
            number, name, both, size = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(name, pa.string()), pa.array(both, pa.int32()), pa.array(size, pa.int32())],
                names=["doc_id", "block_no", "template", "overlap", "template_tokens"],
            )

    some = src.filter("t is not null")
    if len(prefixes) <= LITERAL:
        some = some.filter(F.arrays_overlap(tokens(F.col("t")), F.array(*(F.lit(w) for w in sorted(prefixes)))))
    blocks = some.select("doc_id", F.transform(F.split("t", block_pattern, -1), F.lower).alias("blocks")).filter(F.size("blocks") > 1)
    kind = src.schema["doc_id"].dataType.simpleString()
    return blocks.mapInArrow(run, f"doc_id {kind}, block_no int, template string, overlap int, template_tokens int")


def license_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD, block_pattern: str = BLOCKS, wrapped: bool = False,
) -> DataFrame:
    """(doc_id, block_no, template, overlap, template_tokens): every block that meets a template.

    ``wrapped``: also passages that go over the ends of blocks, however many
    (see :func:`wrapped_passages`).

    ``block_no`` counts the blocks of the text from 0, empty ones too. A block
    may meet several templates, equal templates are each reported, and of
    repeated rows each is. A null or empty text has no tokens and meets
    nothing; neither does a template without tokens. A null id is passed on.
    Texts are read whole, however long. An empty table, or no templates, gives
    no rows. Other columns are not looked at.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    named = spark.createDataFrame([(k, v) for k, v in sorted(templates.items())], "template string, t string")
    sets = {r.template: list(r.tok) for r in named.select("template", tokens(F.col("t")).alias("tok")).collect() if r.tok}
    if not sets:
        return spark.createDataFrame([], f"doc_id {kind}, block_no int, template string, overlap int, template_tokens int")
    every = sorted({w for own in sets.values() for w in own})
    vocabulary = spark.createDataFrame([(w,) for w in every], "token string")
    seen = {r.token: r.n for r in frequencies(src, vocabulary, len(every)).collect()}
    rank = {w: k for k, w in enumerate(sorted(every, key=lambda w: (seen.get(w, 0), w)))}
    by_rank = list(rank)
    prefixes, whole = [], []
    for name, own in sets.items():
        order = sorted(rank[w] for w in own)
        need = needed(len(own), threshold)
        whole.append((name, len(own), need, order))
        prefixes += [(order[i], name, i, len(own), need) for i in range(len(own) - need + 1)]
    ranks = _small(spark.createDataFrame(list(rank.items()), "token string, rank int"), len(rank))
    postings = _small(spark.createDataFrame(prefixes, "rank int, template string, i int, size int, need int"), len(prefixes))
    sizes = _small(spark.createDataFrame(whole, "template string, size int, need int, own array<int>"), sum(len(w[3]) for w in whole))

    blocks = src.filter("t is not null").select("doc_id", F.monotonically_increasing_id().alias("rid"), F.posexplode_outer(F.split("t", block_pattern, -1)).alias("block_no", "block"))
    held = blocks.select("doc_id", "rid", "block_no", tokens(F.col("block")).alias("tok"))
    rare = {p[0] for p in prefixes}
    if len(rare) <= LITERAL:
        # Rare tokens decide at once; nothing of the other blocks is built or sent.
        held = held.filter(F.arrays_overlap("tok", F.array(*(F.lit(w) for w, k in sorted(rank.items()) if k in rare))))
    flat = held.select("doc_id", "rid", "block_no", F.explode_outer("tok").alias("token")).join(ranks, "token")
    ordered = flat.groupBy("rid", "block_no").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    shared = ordered.select("*", F.posexplode("ranks").alias("j", "rank")).join(postings, "rank")
    possible = (F.size("ranks") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("ranks") - F.col("j")) >= F.col("need"))
    # Of the tokens that a pair shares, the first decides: earlier ones would have been shared too.
    first = shared.groupBy("rid", "block_no", "template").agg(F.min(F.struct("j", possible.alias("ok"))).alias("at"), F.first("doc_id", ignorenulls=True).alias("doc_id"), F.first("ranks").alias("ranks"))
    pairs = first.filter("at.ok").join(sizes, "template")
    met = pairs.withColumn("overlap", F.size(F.array_intersect("ranks", "own"))).filter("overlap >= need")
    single = met.select("doc_id", "block_no", "template", "overlap", F.col("size").alias("template_tokens"))
    if not wrapped:
        return single
    anchors = defaultdict(list)
    for place, name, *_ in prefixes:
        anchors[by_rank[place]].append(name)
    return single.unionByName(wrapped_passages(src, templates, dict(anchors), {name: need for name, _, need, _ in whole}, block_pattern))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSE_SQL = f"""
WITH t(template, body) AS (VALUES {", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in sorted(TEMPLATES.items()))}),
s AS (SELECT template, seq, own, len(seq) AS size, (len(own) * 9 + 9) // 10 AS need
      FROM (SELECT template, regexp_extract_all(lower(body), '{TOKENS}') AS seq, list_distinct(regexp_extract_all(lower(body), '{TOKENS}')) AS own FROM t)),
l AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
b AS (SELECT rid, doc_id, unnest(parts) AS block, unnest(range(len(parts))) AS block_no FROM l),
k AS (SELECT rid, doc_id, block_no, regexp_extract_all(lower(block), '{TOKENS}') AS seq FROM b),
single AS (
  SELECT rid, doc_id, CAST(block_no AS INTEGER) AS block_no, template, CAST(len(list_intersect(k.seq, own)) AS INTEGER) AS overlap, CAST(len(own) AS INTEGER) AS template_tokens
  FROM k, s WHERE len(list_intersect(k.seq, own)) >= need
),
w AS (SELECT rid, any_value(doc_id) AS doc_id, flatten(list(seq ORDER BY block_no)) AS words, flatten(list(list_transform(seq, lambda x: block_no) ORDER BY block_no)) AS lines FROM k GROUP BY rid),
c AS (
  SELECT rid, template, size, own, start, len(list_intersect(words[start + 1 : start + size], own)) AS hit
  FROM (SELECT rid, words, template, size, own, need, unnest(range(len(words))) AS start FROM w, s WHERE len(list_intersect(words, own)) >= need)
  WHERE len(list_intersect(words[start + 1 : start + size], own)) >= need
),
g AS (
  SELECT rid, template, list_reduce(list([start] ORDER BY hit DESC, start), lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y - x[1]) < size)) > 0 THEN a ELSE list_concat(a, x) END) AS kept
  FROM c GROUP BY rid, template, size
),
p AS (
  SELECT w.rid, w.doc_id, s.template, own, size, list_intersect(words[start + 1 : start + size], own) AS hit, lines,
         list_filter(range(start, least(start + size, len(words))), lambda i: list_contains(own, words[i + 1])) AS pos
  FROM (SELECT rid, template, unnest(kept) AS start FROM g) g JOIN w ON w.rid = g.rid JOIN s ON s.template = g.template
),
q AS (SELECT rid, doc_id, template, len(hit) AS overlap, len(own) AS template_tokens, lines[pos[1] + 1] AS first_line, lines[pos[len(pos)] + 1] AS last_line FROM p)
SELECT doc_id, block_no, template, overlap, template_tokens FROM single
UNION ALL
SELECT doc_id, CAST(first_line AS INTEGER), template, CAST(overlap AS INTEGER), CAST(template_tokens AS INTEGER)
FROM q WHERE first_line < last_line AND NOT EXISTS (SELECT 1 FROM single WHERE single.rid = q.rid AND single.template = q.template AND single.block_no BETWEEN first_line AND last_line)
"""
