import random
import re

import duckdb

import pytest

from glossator.llm import license_scan


def _brute(rows, templates, threshold):
    cut = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    found = []
    for i, t in rows:
        for n, block in enumerate((t or "").split("\n")):
            for name, body in templates.items():
                own = cut(body)
                both = len(own & cut(block))
                if own and both >= threshold * len(own) - 1e-9:
                    found.append((i, n, name, both, len(own)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.9, 1.0])
@pytest.mark.parametrize("literal", [256, 0])
def test_against_brute_force(spark, threshold, literal, monkeypatch):
    monkeypatch.setattr(license_scan, "LITERAL", literal)
    draw = random.Random(int(threshold * 10))
    words = [f"W{k}" for k in range(14)]
    templates = {f"t{k}": " ".join(draw.choices(words, k=draw.randint(1, 9))) for k in range(8)}
    rows = [(i, "\n".join(" ".join(draw.choices(words + ["other", "More"], k=draw.randint(0, 14))) for _ in range(4))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = license_scan.license_blocks(docs, templates=templates, threshold=threshold).collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, templates, threshold)


def test_edge_cases(spark):
    long = "word " * 40_000 + "\nreleased UNDER the mit license"
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, "x\n\nAll rights reserved."), (4, long), (5, "Released under the MIT")]
    docs = spark.createDataFrame([(*r, 7, "x", 3) for r in rows], "doc_id long, text string, rid int, template string, rank int")
    got = sorted(map(tuple, license_scan.license_blocks(docs).collect()), key=repr)
    assert got == sorted([(1, 0, "mit", 5, 5), (1, 0, "mit", 5, 5), (None, 2, "reserved", 3, 3), (4, 1, "mit", 5, 5)], key=repr)
    assert license_scan.license_blocks(docs.limit(0)).count() == 0
    assert license_scan.license_blocks(docs, templates={}).count() == 0
    assert license_scan.license_blocks(docs, templates={"a": "...", "b": ""}).count() == 0
    twice = license_scan.license_blocks(docs, templates={"a": "all rights reserved", "b": "reserved all rights"}).collect()
    assert sorted(r.template for r in twice) == ["a", "b"]


def test_needed_is_the_least_overlap():
    for threshold in (0.1, 0.35, 0.8, 0.9, 1.0):
        for size in range(1, 200):
            need = license_scan.needed(size, threshold)
            assert need >= threshold * size - 1e-9 and (need == 1 or need - 1 < threshold * size - 1e-9)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal"""
ISC = """ * Permission to use, copy, modify, and/or distribute this software for any
 *
 * purpose with or without fee is hereby granted, provided that the above"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this"""


def test_wrapped_texts_are_found(spark):
    one_each = "\n".join(license_scan.TEMPLATES["bsd-conditions"].split())
    rows = [(1, MIT), (2, "Copyright\n\n" + ISC + "\n" + MPL), (3, one_each), (None, "x\n" + one_each + "\nmore"), (5, "All of us\nhave some other rights, which the\nowner reserved"), (6, "All rights reserved.\nAll rights reserved."), (7, None), (8, "all rights\nreserved all\nrights reserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, license_scan.license_blocks(docs, wrapped=True).collect()), key=repr)
    size = {k: len(set(re.findall("[a-z0-9]+", v.lower()))) for k, v in license_scan.TEMPLATES.items()}
    want = [(1, 0, "mit-grant"), (2, 2, "isc-grant"), (2, 5, "mpl-2.0"), (3, 0, "bsd-conditions"), (None, 1, "bsd-conditions"), (6, 0, "reserved"), (6, 1, "reserved"), (8, 0, "reserved"), (8, 1, "reserved")]
    assert got == sorted([(i, n, t, size[t], size[t]) for i, n, t in want], key=repr)


def test_each_template_is_found_wherever_it_breaks(spark):
    rows = []
    for name, body in license_scan.TEMPLATES.items():
        words = body.split()
        rows += [(f"{name}:{k}", "before it\n" + " ".join(words[:k]) + "\n" + " ".join(words[k:]) + " and after") for k in range(1, len(words))]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    found = {(r.doc_id, r.template) for r in license_scan.license_blocks(docs, wrapped=True).collect()}
    assert all((i, i.split(":")[0]) in found for i, _ in rows)


def _in_sql(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.sql(f"SELECT doc_id, block_no, template, overlap, template_tokens FROM ({license_scan.LICENSE_SQL})").fetchall(), key=repr)


def test_sql_has_wrapped_passages_too(spark):
    draw = random.Random(9)
    rows = [(1, MIT), (2, "Copyright\n\n" + ISC + "\n" + MPL), (None, "all rights\nreserved all\nrights reserved"), (4, None), (5, "")]
    for i, body in enumerate(license_scan.TEMPLATES.values(), 10):
        for k in range(6):
            words = body.replace("\n", " ").split()
            for at in draw.sample(range(len(words)), min(k, len(words) // 12)):
                words[at] = "other"
            text = "".join(w + draw.choice([" ", " ", "\n", "\n * "]) for w in words)
            rows.append((100 * i + k, "before it\n" + text + "\nafter " + (text if k == 5 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, license_scan.license_blocks(docs, wrapped=True).collect()), key=repr)
    assert got == _in_sql(rows) and {r[2] for r in got} == set(license_scan.TEMPLATES)


def test_a_large_set_of_templates_is_joined_without_broadcast(spark, monkeypatch):
    draw = random.Random(1)
    words = [f"W{k}" for k in range(40)]
    templates = {f"t{k}": " ".join(draw.choices(words, k=draw.randint(1, 9))) for k in range(30)}
    rows = [(i, "\n".join(" ".join(draw.choices(words, k=draw.randint(0, 14))) for _ in range(4))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(license_scan, "LITERAL", 0)
    assert sorted(map(tuple, license_scan.license_blocks(docs, templates=templates, threshold=0.6).collect()), key=repr) == _brute(rows, templates, 0.6)
