"""Exact, near and line dedup against brute force, and their edge cases."""

import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from llm_fixtures import docs, prose  # noqa: F401
from plumbline.llm import line_dedup, near_dedup
from plumbline.llm.components import components
from plumbline.llm.decontaminate import drop_contaminated
from plumbline.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def _rows(frame, key="doc_id"):
    return {row[key]: row for row in frame.collect()}


def test_exact_groups(docs):
    frame = docs((1, "Same"), (2, "sAME"), (3, "other"), (9, "same"), (4, None), (5, ""), (6, "É"), (7, "é"))
    got = _rows(exact_duplicates(frame, keep="largest"))
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in got.items()} == {
        1: (9, 3, False), 2: (9, 3, False), 9: (9, 3, True), 3: (3, 1, True),
        4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True), 7: (7, 1, True),
    }
    assert got[1]["text_sha256"] == hashlib.sha256(b"same").hexdigest()
    smallest = _rows(exact_duplicates(frame, keep="smallest"))
    assert smallest[9]["keep_id"] == 1 and smallest[1]["kept"]


def test_exact_edges(docs):
    assert exact_duplicates(docs().limit(0)).count() == 0
    assert drop_exact_duplicates(docs().limit(0)).count() == 0
    twice = exact_duplicates(docs((1, "a"), (1, "a"), (None, "b"), (None, "b"), (3, "b")), keep="largest").collect()
    assert sorted((r["doc_id"] or 0, r["group_size"], r["kept"]) for r in twice) == [
        (0, 3, False), (0, 3, False), (1, 2, True), (1, 2, True), (3, 3, True),
    ]
    kept = drop_exact_duplicates(docs((1, "x"), (2, "X"), (3, "y")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def _brute(texts, percent=85):
    def shingles(text):
        words = (text or "").encode().lower().split()
        if not words:
            return set()
        return set(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else {tuple(words)}

    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_components(docs, prose):
    base = prose(1, 200).split()
    rows = [(100 + k, prose(k + 50)) for k in range(20)]
    for k in range(60):  # a family with ever more changes
        words = list(base)
        for j in range(k % 12):
            words[(17 * j + 5 * k) % 200] = f"changed{k}x{j}"
        rows.append((k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "ONE  two"), (205, "two one"), (206, " ".join(base).upper())]
    got = _rows(near_dedup.near_duplicates(docs(*rows)))
    want = _brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_cells(docs, prose, monkeypatch):
    """The same components when stars are cut into many cells."""
    monkeypatch.setattr(near_dedup, "CELL", 4)
    base = prose(3, 120).split()
    rows = []
    for k in range(40):
        words = list(base)
        for j in range(k % 7):
            words[(13 * j + 3 * (k // 2)) % 120] = f"c{k // 2}x{j}"
        rows.append((k, " ".join(words)))
    got = _rows(near_dedup.near_duplicates(docs(*rows)))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in _brute(rows).items()}


def test_links_of_small_stars_take_little_room():
    """Two members with few changes are compared in matrices of their own size, with the right links."""
    ids = np.arange(1000, dtype="<u8")
    rows = [  # star, id, component, lacks, adds
        (1, 2, 2, range(0, 5), ids[:5]), (1, 3, 3, range(2, 7), ids[:4]), (1, 4, 4, range(50, 80), ids[500:530]), (1, 5, 2, range(1, 6), ids[:5]),
        (9, 12, 12, range(3), ids[:0]), (9, 13, 12, range(3), ids[:1]), (9, 14, 14, range(60), ids[900:960]),
    ]
    frame = pd.DataFrame([
        {"a": a, "b": b, "n_a": 100, "n_b": 100 - len(minus) + len(plus), "minus": np.array(minus, "<i4").tobytes(), "plus": plus.tobytes(),
         "comp": comp, "part": 0, "row": 0, "column": 0} for a, b, comp, minus, plus in rows
    ])
    tracemalloc.start()
    got = near_dedup._links_of(85)(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_numpy().tolist() == [[2, 3]]
    assert peak < 1 << 20


def test_near_edges(docs, prose):
    assert near_dedup.near_duplicates(docs().limit(0)).count() == 0
    got = near_dedup.near_duplicates(docs((None, prose(1)), (1, prose(1)), (1, prose(1)), (2, prose(1)))).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = near_dedup.drop_near_duplicates(docs((5, prose(1)), (7, prose(1) + " more"), (9, prose(2))))
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 9]


def test_estimate_is_close(prose):
    import numpy as np

    from plumbline.llm.near_dedup import estimate, registers, shingle_sets

    words = prose(5, 2000).split()
    texts = [" ".join(words).encode(), " ".join(words[:1700] + prose(6, 300).split()).encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
    h, owner = shingle_sets(data, at)
    n = np.bincount(owner)
    signature = registers(h, owner, 2)
    guess, _ = estimate(signature[:1], signature[1:], n[:1], n[1:])
    a, b = (set(h[owner == k].tolist()) for k in (0, 1))
    assert abs(guess[0] - len(a & b) / len(a | b)) < 0.15


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_lines(docs):
    long = "one two three four five six"
    frame = docs(
        (1, f"{long}\n\nshort\n{long} seven"),
        (2, f"short\none two three FOUR five six\nunlike in every single word here"),
        (3, "two three four five six\none  two\tthree four five six"),
        (4, "one two three four\none two three five"),
        (5, None),
        (6, ""),
    )
    got = _rows(line_dedup.line_report(frame))
    assert {i: (r["n_lines"], r["removed_lines"]) for i, r in got.items()} == {
        1: (4, "3"), 2: (3, "0,1"), 3: (2, "0,1"), 4: (2, ""), 5: (1, ""), 6: (1, ""),
    }
    texts = {r["doc_id"]: r["text"] for r in line_dedup.drop_duplicate_lines(frame).collect()}
    assert texts[1] == f"{long}\n\nshort" and texts[2] == "unlike in every single word here" and texts[5] == ""
    assert line_dedup.line_report(docs().limit(0)).count() == 0


def test_lines_by_brute_force(docs, prose):
    rows = []
    for k in range(30):
        words = prose(k // 6, 9).split()
        if k % 3 == 1:
            words[k % 9] = f"new{k}"
        if k % 3 == 2:
            del words[k % 9]
        rows.append((k, " ".join(words)))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    split = [(i, t.split()) for i, t in rows]
    want = {i for i, a in split if any(j < i and near(a, b) for j, b in split)}
    got = {r["doc_id"] for r in line_dedup.line_report(docs(*rows)).collect() if r["n_removed"]}
    assert got == want


def test_lines_meet_before_they_move(docs, prose, monkeypatch):
    """Only variants whose key another variant has are joined; lines that share a half alone have none."""
    staged, stage = {}, line_dedup.Scratch.stage

    def spy(self, df, name, **kwargs):
        out = stage(self, df, name, **kwargs)
        staged[name] = (out.columns, out.count())
        return out

    monkeypatch.setattr(line_dedup.Scratch, "stage", spy)
    head = prose(1, 10)
    rows = [(k, f"{head} {prose(k + 10, 10)}") for k in range(20)] + [(50, prose(2, 8)), (51, prose(2, 8) + " more")]
    got = {r["doc_id"] for r in line_dedup.line_report(docs(*rows)).collect() if r["n_removed"]}
    assert got == {51}
    assert staged["variants"][1] == 20 * 21 + 9 + 10
    assert staged["meeting"] == (["place", "at", "key"], 2)


def _texts(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("kind", ["int", "long"])
def test_drops_by_row_not_by_id(spark, prose, kind):
    a, b, c, null = prose(1), prose(2), prose(3), None
    near = a + " more"
    frame = lambda *rows: spark.createDataFrame(list(rows), f"doc_id {kind}, text string")
    exact = drop_exact_duplicates(frame((null, c), (null, b), (7, b), (5, a), (5, c + "x"), (9, a), (8, "q"), (8, "Q"), (null, "z"), (null, "z")))
    assert [(i, t.lower()) for i, t in _texts(exact)] == sorted([(null, c), (7, b), (5, c + "x"), (9, a), (8, "q"), (null, "z")], key=str)
    left = near_dedup.drop_near_duplicates(frame((null, c), (null, near), (5, a), (5, b), (9, near), (9, c), (5, b), (6, prose(4)), (6, prose(4) + " x")))
    got = _texts(left)
    assert [row for row in got if row[0] != 6] == sorted([(null, c), (null, near), (5, a), (5, b), (9, c)], key=str)
    assert [i for i, _ in got].count(6) == 1
    bench = spark.createDataFrame([("q", b)], "item_id string, text string")
    clean = drop_contaminated(frame((null, a), (null, b), (5, b + " x"), (5, c), (7, a)), bench)
    assert _texts(clean) == sorted([(null, a), (5, c), (7, a)], key=str)


def test_lines_of_rows_that_share_an_id(docs, prose):
    """Equal and near lines under one id, null ids included: of each group one line stays."""
    one, two = prose(1, 8), prose(2, 8)
    near = one.rsplit(" ", 1)[0] + " other"
    rows = [(None, one), (None, one + "\nsecond line"), (1, two), (1, two + "\nmore"), (5, near), (5, near + "\nx"), (5, "y\n" + near)]
    kept = [line for row in line_dedup.drop_duplicate_lines(docs(*rows)).collect() for line in row["text"].split("\n")]
    assert kept.count(two) == 1 and kept.count(one) + kept.count(near) == 1 and kept.count(near) == 1
    got = line_dedup.line_report(docs(*rows)).collect()
    assert sum(r["n_removed"] for r in got) == 5 and sum(r["n_lines"] for r in got) == 11
    # The very same row twice loses the same lines, which is none.
    assert {r["n_removed"] for r in line_dedup.line_report(docs((3, one), (3, one))).collect()} == {0}
