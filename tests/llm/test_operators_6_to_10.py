import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import odd_rows, passage, words
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.jaccard_join import jaccard_join, prefix_length
from factloom.llm.license_rules import BASE, rules
from factloom.llm.license_scans import MARGIN, license_scan
from factloom.llm.line_dedup import line_dedup, longest_block, patience
from factloom.llm.repetition_rules import longest_repeats, repetition_rules
from factloom.llm.source_mixing import mixed


def judged(text):
    w = words(text)
    n = len(w)
    longest = [0] * n
    k, live = 5, list(range(n - 4))
    while live:
        seen = Counter(tuple(w[i : i + k]) for i in live)
        live = [i for i in live if seen[tuple(w[i : i + k])] > 1]
        for i in live:
            longest[i] = k
        k += 1
        live = [i for i in live if i + k <= n]
    cover = {q for i, x in enumerate(longest) if x >= 5 for q in range(i, i + x)}
    again = {q for i, x in enumerate(longest) if x >= 8 for q in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = n < 20 or 100 * len(again) > 30 * n
    top = max(longest, default=0)
    return (
        n,
        sum(len(x.decode()) for x in w),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(again),
        failed,
        not failed and len(cover) <= 0.4 * n and top <= 200,
        len(cover),
        top,
    )


def test_repetition_rules(odd, none, documents):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat"]
    for df in (odd, documents):
        got = sorted((tuple(r) for r in repetition_rules(df).select(*columns).collect()), key=repr)
        assert got == sorted(((r["doc_id"], *judged(r["text"])) for r in df.collect()), key=repr)
    assert repetition_rules(none).count() == 0
    assert set(repetition_rules(odd, keep=("text", "lang")).columns) >= {"kept", "text", "lang"}


def test_longest_repeats_by_brute_force():
    rng = np.random.default_rng(2)
    for n, kinds in ((40, 2), (200, 3), (1, 1), (0, 1), (64, 1)):
        w = rng.integers(0, kinds, n).astype(np.uint64)
        text = np.sort(rng.integers(0, 3, n))
        want = []
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and text[i + k] == text[i] and text[j + k] == text[i] and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        assert longest_repeats(w, text).tolist() == want


def scanned(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    norm = " ".join(w)
    padded = f" {norm} "
    base = []
    for label, phrase in BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    spans = []
    for rank, (label, priority, keyword, pattern) in enumerate(rules()):
        if keyword in norm:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", padded):
                first = padded[: m.start()].count(" ") - 1
                spans.append((first, first + m.group().count(" "), rank, label, priority))
    kept = []
    for s in spans:
        for t in spans:
            if t[0] <= s[0] and t[1] >= s[1]:
                if t[1] - t[0] > s[1] - s[0]:
                    if t[4] >= s[4]:
                        break
                elif t[4] > s[4] or (t[4] == s[4] and t[2] < s[2]):
                    break
        else:
            kept.append(s)
    starts = [i for i, _ in base]
    labels = {x for _, x in base}
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[3] for s in kept})), max((s[4] for s in kept), default=0) / 100, len(kept))


NOTICES = [
    "mit license mit license apache license gnu general public license",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "GNU General Public License, version 3.",
    "This work is under Creative Commons Attribution-NonCommercial 4.0 International License. All rights reserved. Copyright 2020 x",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Copyright (c) 2019 Foo. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MITlicense mit license MIT\nLICENSE mit\x85license",
    "licensed under see the license file",
]


def test_license_scan(spark, odd, none, documents):
    notices = spark.createDataFrame([(i, t) for i, t in enumerate(NOTICES)], "doc_id long, text string")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_kept"]
    for df in (odd, notices, documents):
        got = sorted((tuple(r) for r in license_scan(df).select(*columns).collect()), key=repr)
        assert got == sorted(((r["doc_id"], *scanned(r["text"])) for r in df.collect()), key=repr)
    assert license_scan(none).count() == 0
    found = {r["doc_id"]: r["labels"].split(",") for r in license_scan(notices).collect()}
    assert "gpl-2-or-later" in found[2] and "gpl-3" in found[3] and "cc-by-nc-4.0" in found[4] and "bsd-2-clause" in found[5]


def test_rules_are_many_and_sound():
    assert len(rules()) >= 200
    for label, priority, keyword, pattern in rules():
        assert 0 < priority <= 100 and label and keyword == keyword.lower()
        re.compile(pattern)


def drawn(df, **kw):
    return mixed(df, **kw).collect()


def test_mixing_limits_repetition(spark, none, odd):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = drawn(df, most_repeats=2.0)
    total, out, repeats = Counter(), Counter(), {}
    for r in got:
        total[r["source"]] += r["n_tokens"]
        out[r["source"]] += r["n_tokens"] * r["copies"]
        repeats[r["source"]] = r["repeats"]
        assert r["copies"] >= 1
    assert 1.99 < max(repeats.values()) <= 2.0 + 1e-6 and abs(min(repeats.values()) - 1) < 1e-6
    for s in total:
        assert abs(out[s] - repeats[s] * total[s]) <= 7
    p = {s: n / sum(total.values()) for s, n in total.items()}
    a = got[0]["exponent"]
    z = sum(x**a for x in p.values())
    for r in got[:50]:
        assert abs(r["weight"] - p[r["source"]] ** a / z) < 1e-9
    assert mixed(none).count() == 0
    assert mixed(odd).count() == odd.count()


def test_mixing_meets_entropy_and_budget(spark):
    rows = [(i, "a b c d", "big" if i % 4 else "small") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = drawn(df, entropy=0.65, budget=4000)
    w = {r["source"]: r["weight"] for r in got}
    assert 0.65 <= -sum(x * math.log(x) for x in w.values()) < 0.651
    assert abs(sum(r["n_tokens"] * r["copies"] for r in got) - 4000) <= 8
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in drawn(df.repartition(5), entropy=0.65, budget=4000)}


def classes_by_force(rows, k=5, threshold=0.8):
    rows = [(i, words(t)) for i, t in rows if i is not None]
    sets = [{tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set() for _, w in rows]
    n = len(rows)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(n):
            common = len(sets[a] & sets[b])
            if a != b and common and common >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                parent[root(a)] = root(b)
    least = {}
    for x in range(n):
        least[root(x)] = min(least.get(root(x), rows[x][0]), rows[x][0])
    return sorted((rows[x][0], least[root(x)], links[x]) for x in range(n))


def found_classes(df, **kw):
    return sorted(tuple(r) for r in jaccard_join(df, **kw).select("doc_id", "class_id", "n_links").collect())


def test_jaccard_join(spark, odd, none):
    assert found_classes(odd) == classes_by_force([r[:2] for r in odd_rows()])
    assert jaccard_join(none).count() == 0
    rows = []
    for g in range(12):
        base = passage(80, 200 + g).split()
        for c in range(9):
            w = list(base)
            for e in range(c % 4):
                w[(7 * c + 13 * e) % 80] = f"edit{g}.{c}.{e}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_classes(df) == classes_by_force(rows)
    assert found_classes(df, block_rows=3) == classes_by_force(rows)


def test_prefix_is_shortened_until_recall():
    assert prefix_length(0.8, 24, 6, 0.99) == 6 and prefix_length(0.8, 24, 6, 0.9999) == 5
    with pytest.raises(ValueError):
        prefix_length(0.8, 1, 6, 0.9999)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 4), (6, 5)] + [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[9] == got[1] == 1 and got[6] == 5 and got[160] == 100 and got[530] == 500 and 7 not in got and 4 not in got


def aligned_by_force(a, b):
    """Longest increasing chain of lines unique on both sides, grown while equal."""
    unique = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    best = []
    for i, j in unique:
        chain = max((c for c in best if c[-1][1] < j), key=len, default=[])
        best.append([*chain, (i, j)])
    return max(best, key=len, default=[])


def test_patience():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(0, 12, rng.integers(0, 12)).tolist(), rng.integers(0, 12, rng.integers(0, 12)).tolist()
        blocks = patience(a, b)
        end_a = end_b = 0
        for i, j, n in blocks:
            assert n > 0 and i >= end_a and j >= end_b and a[i : i + n] == b[j : j + n]
            end_a, end_b = i + n, j + n
        chain = aligned_by_force(a, b)
        inside = sum(1 for x in set(a) if a.count(x) == 1 and b.count(x) == 1 and any(i <= a.index(x) < i + n and j <= b.index(x) < j + n for i, j, n in blocks))
        assert inside >= len(chain)
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert patience([1, 1], [1, 1]) in ([(0, 0, 2)], [(0, 0, 1), (1, 1, 1)])
    assert patience([], [1]) == []


def lines_left(rows, least_words=10):
    """Each document against the first holder of each of its lines."""
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for x in t.split("\n"):
            if words(x):
                first.setdefault(x, (i, t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        if i is not None and t is not None:
            for j, u in {first[x] for x in lines if words(x)}:
                if j < i:
                    for _, b, n in patience(u.split("\n"), lines):
                        if sum(len(words(x)) for x in lines[b : b + n]) >= least_words:
                            gone |= set(range(b, b + n))
        n = sum(1 for x in lines if words(x))
        out.append((i, n, sum(1 for q in gone if words(lines[q])), t if not gone else "\n".join(x for q, x in enumerate(lines) if q not in gone)))
    return sorted(out, key=repr)


def test_line_dedup(odd, none, documents):
    for df in (odd, documents):
        got = sorted((tuple(r) for r in line_dedup(df).select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr)
        assert got == lines_left([(r["doc_id"], r["text"]) for r in df.collect()])
    assert line_dedup(none).count() == 0
    assert line_dedup(odd, keep=("lang", "lines")).columns == ["doc_id", "lang", "lines", "n_lines", "n_removed", "text"]


def left_by_every_pair(rows, aligned, least_words=10):
    """Lines left of each document by every earlier one: by its alignment, or by any common run of enough words."""
    out = {}
    for j, u in rows:
        b = u.split("\n")
        n = [len(words(x)) for x in b]
        gone = set()
        for a in (t.split("\n") for i, t in rows if i < j):
            blocks = patience(a, b) if aligned else [(p, q, k) for p in range(len(a)) for q in range(len(b)) for k in range(1, len(b) + 1) if a[p : p + k] == b[q : q + k]]
            for _, q, k in blocks:
                if sum(n[q : q + k]) >= least_words:
                    gone |= set(range(q, q + k))
        out[j] = Counter(x for q, x in enumerate(b) if q not in gone)
    return out


def test_line_dedup_meets_every_earlier_document(spark):
    z, w = passage(6, 50), passage(6, 51)
    short = [passage(6, 60 + i) for i in range(3)]
    long, other = passage(60, 70), passage(12, 57)
    cases = [
        [[short[0], z], [w, short[1]], short[:2], [passage(6, 52), *short[:2], passage(6, 53)]],
        [[long, z, long], [w, long], [passage(6, 54), long]],
        [[long, other, z], [other, w, long]],
        [[long, z], [w, long], [long, passage(6, 55), long]],
    ]
    rng = np.random.default_rng(10)
    pool = [*short, "", long, passage(3, 71), passage(10, 72)]
    cases += [[[pool[x] for x in rng.integers(0, len(pool), rng.integers(1, 9))] for _ in range(5)] for _ in range(30)]
    for n, case in enumerate(cases):  # cases share no line
        case[:] = ["\n".join(" ".join(f"{y}c{n}" for y in x.split()) for x in d) for d in case]
    rows = [(10 * n + i, d) for n, case in enumerate(cases) for i, d in enumerate(case)]
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    some, most = left_by_every_pair(rows, True), left_by_every_pair(rows, False)
    for i, lines in got.items():
        left = Counter(x for x in lines if x)  # without blank ones, which an empty text cannot show
        assert all(left[x] <= some[i][x] for x in left), i
        assert all(left[x] >= most[i][x] for x in most[i] if x), i
    assert got[3] == [" ".join(f"{y}c0" for y in passage(6, x).split()) for x in (52, 53)]
    assert [len("\n".join(got[i]).split()) for i in (11, 12, 21, 31, 32)] == [6, 6, 6, 6, 6]


def test_patience_aligns_gaps_and_repeated_lines():
    p, q, r, s, x, y = range(6)
    assert [n for _, _, n in patience([p, x, y], [q, p, r, p, s])] == [1]
    assert patience([p, q, p, q, x, r, s, r], [y, p, q, p, q, y, y, r, s, r]) == [(0, 1, 4), (5, 7, 3)]
    assert patience([p, p, x, q, q, r], [y, p, p, y, q, q, r]) == [(0, 1, 2), (3, 4, 3)]  # gaps beside an anchor
    assert patience([p, q, x, q, r], [q, r, y, p, q, x, q]) in ([(0, 3, 4)], [(0, 3, 2), (2, 5, 2)])
    rng = np.random.default_rng(12)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 14)).tolist(), rng.integers(0, 4, rng.integers(1, 14)).tolist()
        i, j, n = longest_block(a, b)
        assert a[i : i + n] == b[j : j + n]
        assert n == max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, len(a) + 1) if i + k <= len(a) and j + k <= len(b) and a[i : i + k] == b[j : j + k]), default=0)
        end_a = end_b = 0
        for i, j, n in [*patience(a, b), (len(a), len(b), 0)]:  # no gap has a common line left
            assert set(a[end_a:i]).isdisjoint(b[end_b:j])
            end_a, end_b = i + n, j + n
    many = rng.integers(0, 3, 20000).tolist()
    assert sum(n for _, _, n in patience(many, [9, *many[5:], 9])) >= 19995


def test_line_dedup_aligns_lines_that_repeat(spark):
    long = passage(60, 80)
    q, r, s, x, y = (passage(3, 90 + i) for i in range(5))
    rows = [(1, [long, x, y]), (2, [q, long, r, long, s])]
    got = {i: t for i, t in line_dedup(spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")).select("doc_id", "text").collect()}
    assert got[2].split("\n") in ([q, r, long, s], [q, long, r, s])


def test_rules_are_tried_wherever_their_pattern_matches(spark):
    texts = [
        "The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \u201cAS IS\u201d.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "PostgreSQL Licence",
    ]
    found = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in found.collect()}
    for i, (label, least) in enumerate([("mit", 92), ("gpl", 90), ("postgresql", 70)]):
        assert label in found[i][0] and found[i][1] >= least / 100


def samples(parsed):
    """Words of every way through a pattern; a run of any characters is one letter."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            ways = [chr(arg)]
        elif name == "IN":
            ways = [chr(x) if str(kind) == "LITERAL" else chr(x[0]) if str(kind) == "RANGE" else "x" for kind, x in arg]
        elif name == "SUBPATTERN":
            ways = samples(arg[-1])
        elif name == "BRANCH":
            ways = [w for x in arg[1] for w in samples(x)]
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            low, high, inner = arg
            one = samples(inner)
            times = {int(low), 1, int(high)} - {0} if int(high) < 99 else {1}
            ways = [""] * (low == 0) + [w * n for w in one for n in sorted(times) if n >= low]
        out = [a + b for a in out for b in ways]
    return out


def test_every_match_holds_its_keyword_and_is_short():
    for _, _, keyword, pattern in rules():
        for text in samples(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, text) and keyword in text and text.count(" ") < MARGIN, (keyword, pattern, text)


def test_license_scan_of_long_texts(spark):
    notice = "The above copyright notice and this permission notice shall be included in all copies. The software is provided as is."
    filler = "word " * 497
    texts = [
        f"{notice} {'word ' * 200_000} this permission notice",
        " ".join(filler[: 5 * n] + "Licensed under the MIT License" for n in (490, 495, 497, 10, 508)),
        "licensed under " * 3000,
        "mit license " * 2000 + "GNU General Public License version 3",
    ]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_kept"]
    got = sorted(tuple(r) for r in license_scan(df).select(*columns).collect())
    assert got[:2] == [(i, *scanned(t)) for i, t in rows[:2]]
    assert got[2][1:] == (6000, 0, None, None, "", "license-hint", 0.2, 3000)
    assert got[3][1:8] == (4006, 2001, 0, 4001, "gpl,mit", "gpl,gpl-3,mit", 0.84)


def test_documents_drawn_by_brute_force(spark, documents):
    """Every source's permutation walked document by document: whole epochs, then as many tokens as are left."""
    from factloom.llm.source_mixing import keyed

    repeated = documents.limit(5)
    df = documents.unionByName(repeated).unionByName(documents.limit(7).withColumn("source", F.lit("twin")))
    blocks, seed = 5, 17
    rows = df.select("doc_id", "source", "text", F.xxhash64("text").alias("h"), F.pmod(keyed(seed, "doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int").alias("block"))
    rows = rows.select("*", keyed(seed + 1, "block").alias("k1"), keyed(seed + 2, "doc_id", "h").alias("k2")).collect()
    total = Counter()
    for r in rows:
        total[r["source"]] += len(words(r["text"]))
    for kw in (dict(budget_ratio=1.0), dict(budget=5000, entropy=1.0), {}):
        got = mixed(df, blocks=blocks, seed=seed, **kw).collect()
        a = got[0]["exponent"]
        all_tokens = sum(total.values())
        p = {s: n / all_tokens for s, n in total.items()}
        z = sum(x**a for x in p.values())
        drawn = kw.get("budget") or (all_tokens if "budget_ratio" in kw else all_tokens * z / min(x ** (a - 1) for x in p.values()))
        want = []
        for s, n in total.items():
            repeats = round(p[s] ** a / z * drawn / n, 9)
            part, before = round((repeats - math.floor(repeats)) * n), 0
            for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["k1"], r["block"], r["k2"], r["doc_id"], r["h"])):
                t = len(words(r["text"]))
                want.append((r["doc_id"], s, math.floor(repeats) + int(0 < t and before + t <= part), before))
                before += t
        assert Counter((r["doc_id"], r["source"], r["copies"], r["place"]) for r in got) == Counter(want)


def test_mixing_keeps_sources_of_repeated_rows_apart(spark):
    rows = [(1, "a b c", "small"), (1, "a b c", "big")] + [(i, "a b c d", "big") for i in range(2, 900)] + [(i, "a b c d", "small") for i in range(900, 910)]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string")
    got = mixed(df, keep=("text", "lang")).collect()
    weight = {r["source"]: r["weight"] for r in got if r["doc_id"] != 1}
    assert {(r["source"], r["weight"], r["copies"]) for r in got if r["doc_id"] == 1} == {("small", weight["small"], 2), ("big", weight["big"], 1)}
