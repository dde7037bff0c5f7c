"""Token counts and alignment against the vocabularies' own libraries, whitening against numpy."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_fixtures import docs, prose  # noqa: F401
from plumbline.llm import alignment, frequent, spectral, token_counts, whitening

ALPHABET = list("abcde the ing  \n\n\t\r.,'\"é漢字日本 ▁\x00\x85　😀０") + [
    "<s></s><unk><0x0A>", "<|endoftext|>", "hello", "    ", "\r\n", "a" * 50, "ation", "'s", "don't 12345", "ʼń",
]


def _random_texts(seed, n, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())


@pytest.fixture(scope="module")
def bytelevel():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(alignment.default_vocabularies()[0])
    out.encode_special_tokens = True
    return out


def test_pre_tokens_add_up_to_the_library(pieces):
    own = token_counts.pieces_of(token_counts.default_vocabulary())
    for text in _random_texts(1, 3000):
        names = own.tokens(text)
        assert sum(own.counts([token_counts.literal(name) for name in names])) == len(pieces.encode(text)), text


def test_other_kinds_of_vocabulary_are_refused():
    path = alignment.default_vocabularies()[0]
    with pytest.raises(Exception):
        token_counts.Pieces(path)


def test_token_counts(docs, pieces, monkeypatch):
    texts = [None, "", " ", "a", "a", "two words", "x" * 5000, "  lead", "trail ", "漢字" * 3000, "word " * 5000]
    texts += _random_texts(2, 300)
    rows = [(i // 2 if i else None, text) for i, text in enumerate(texts)]
    want = Counter()
    for i, text in rows:
        n = len(pieces.encode(text or ""))
        want[i, len((text or "").encode()), n, n > 4096] += 1
    # A dictionary of a few entries sends most pre-tokens through the join.
    for entries in (token_counts.DICTIONARY, 3, 0):
        monkeypatch.setattr(token_counts, "DICTIONARY", entries)
        got = token_counts.token_counts(docs(*rows).repartition(3)).collect()
        assert Counter(map(tuple, got)) == want
    assert token_counts.token_counts(docs()).collect() == []


def test_frequent_is_bounded(spark):
    counts = spark.createDataFrame([(i, i) for i in range(1, 400)], "k long, n long")
    for most in (0, 1, 10, 100, 399):
        got = [row.n for row in frequent.frequent(counts, "n", most).collect()]
        assert len(got) <= most and (not got or min(got) > max(set(range(400)) - set(got)))
    assert len(frequent.frequent(counts, "n", 399).collect()) == 399


def _plain_groups(both, text, bytelevel, pieces):
    """Ids of both vocabularies and the groups, straight from the definition."""
    if not text:
        return [], [], []
    a = bytelevel.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    whole = (" " + text).encode()
    if b"".join(both.bytes[0][i] for i in a) != whole or b"".join(both.bytes[1][i] for i in b) != whole:
        return [], [], []
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in zip(both.bytes, (a, b))]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        stop_i, stop_j = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:stop_i], b[j:stop_j]))
        i, j = stop_i, stop_j
    return a, b, groups


def _plain_alignment(rows, bytelevel, pieces):
    both = alignment.both_of(*alignment.default_vocabularies())
    seen, holders = [], Counter()
    for i, text in rows:
        a, b, groups = _plain_groups(both, text, bytelevel, pieces)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        holders.update(links.keys())
        seen.append((i, a, b, groups, links))
    highest = defaultdict(int)
    for (x, _), n in holders.items():
        highest[x] = max(highest[x], n)
    out = Counter()
    for i, a, b, groups, links in seen:
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        best = sum(n for pair, n in links.items() if holders[pair] == highest[pair[0]])
        total = sum(n * holders[pair] for pair, n in links.items())
        out[i, len(a), len(b), len(groups), sum(links.values()), best, total, digest] += 1
    return out


def test_merge_path_pieces_are_equal_and_stitched():
    rng = np.random.default_rng(5)
    for _ in range(300):
        top = int(rng.integers(1, 60))
        ends = [np.union1d(rng.choice(np.arange(1, top + 1), rng.integers(1, top + 1)), [top]) for _ in range(2)]
        work = int(rng.integers(1, 9))
        cuts = alignment.merge_path(*ends, work)
        steps = cuts.sum(axis=1)
        assert (np.diff(steps)[:-1] == work).all() and steps[-1] == len(ends[0]) + len(ends[1])
        common = np.intersect1d(*ends)
        left, right = alignment.group_ends(*ends, work)
        assert (ends[0][left - 1] == common).all() and (ends[1][right - 1] == common).all() and len(left) == len(common)


def test_alignment(docs, bytelevel, pieces, monkeypatch):
    texts = [None, "", " ", "a", "a", "two words", "two words again", "x" * 3000, "  lead", "trail ", "漢字" * 300, "of the " * 900]
    texts += ["abc " + "zq" * 700, " \n x", "\r\r x", "a \rb", "\n \n", "▁"] + _random_texts(3, 400)
    rows = [(i // 2 if i else None, text) for i, text in enumerate(texts)]
    want = _plain_alignment(rows, bytelevel, pieces)
    for table, work, slice_chars, large in ((alignment.TABLE, 7, 50, 4), (20, alignment.PIECE, 1 << 20, 1 << 10), (0, 64, 500, 1)):
        for name, value in (("TABLE", table), ("SLICE_CHARS", slice_chars), ("LARGE", large)):
            monkeypatch.setattr(alignment, name, value)
        monkeypatch.setattr(alignment.group_ends, "__defaults__", (work,))
        got = alignment.aligned_documents(docs(*rows).repartition(3)).collect()
        assert Counter(map(tuple, got)) == want
    assert alignment.aligned_documents(docs()).collect() == []


def test_leading_pairs():
    rng = np.random.default_rng(0)
    flat = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    tall = rng.normal(size=(90, 40))
    for matrix in (
        tall.T @ tall, np.diag([3.0, 3, 3, 1, 0, 0]), np.ones((12, 12)), np.zeros((3, 3)), np.array([[4.0]]),
        (flat * np.repeat([5.0, 2.0], 10)) @ flat.T, np.diag([1e-200, 1.0]),
    ):
        values, vectors = spectral.leading_pairs(matrix, 8)
        count = min(8, len(matrix))
        exact = np.linalg.eigvalsh(matrix)[::-1][:count]
        scale = max(np.abs(exact).max(), 1e-300)
        assert np.abs(values - exact).max() <= 1e-13 * scale
        assert np.abs(vectors @ vectors.T - np.eye(count)).max() < 1e-13
        assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12 * scale


VECTORS = "vec_id int, embedding array<float>, label int, n long, v string, component int"


def _plain_whitening(rows, components=8):
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    length = Counter(len(v) for _, v in usable).most_common(1)[0][0]
    usable = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in usable if len(v) == length]
    n, sums = len(usable), [sum(column) for column in zip(*[x for _, x in usable])]
    z = [[n * c - s for c, s in zip(x, sums)] for _, x in usable]
    exact = [[sum(r[i] * r[j] for r in z) / n**3 for j in range(length)] for i in range(length)]
    values, vectors = np.linalg.eigh(np.array(exact))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    whitened = np.array(z, float) / n @ vectors / np.sqrt(values)
    return [i for i, _ in usable], n, [sum(c * c for c in r) for r in z], whitened, values / np.trace(np.array(exact))


def test_whitening(spark):
    rng = np.random.default_rng(7)
    spread = rng.normal(size=(300, 12)) * np.linspace(0.1, 1.2, 12)
    rows = [(i // 2 if i else None, [float(c) for c in row]) for i, row in enumerate(spread)]
    rows += [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [0.5] * 11), (904, [0.1] * 5), (905, [float("-inf")] * 12)]
    rows += [rows[5]] * 100
    ids, n, deviation, whitened, explained = _plain_whitening(rows)
    for parts in (1, 3, 7):
        frame = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS).repartition(parts)
        got = whitening.whiten(frame).collect()
        assert len(got) == 8 * n and Counter(r.vec_id for r in got) == Counter({i: 8 * c for i, c in Counter(ids).items()})
        assert {r.n for r in got} == {n} and all(r.identity_error == got[0].identity_error < 1e-10 for r in got)
        for k in range(8):
            mine = sorted((int(r.deviation), r.whitened) for r in got if r.component == k + 1)
            plain = sorted(zip(deviation, whitened[:, k]))
            assert [d for d, _ in mine] == [d for d, _ in plain]
            a, b = np.array([w for _, w in mine]), np.array([w for _, w in plain])
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
            assert all(abs(r.explained - explained[k]) < 1e-12 for r in got if r.component == k + 1)


def test_whitening_without_variance(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).collect() == []
    flat = spark.createDataFrame([(i, [0.5, 0.25], 1, 2, "x", 3) for i in range(9)], VECTORS)
    assert whitening.whiten(flat).collect() == []
    line = spark.createDataFrame([(i, [float(i), 0.25, 2.0 * i], 1, 2, "x", 3) for i in range(9)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].explained == pytest.approx(1)


def test_sums_of_large_entries_are_exact():
    y = np.array([[1 << 30, -3], [(1 << 31) + 1, 5], [7, 1 << 26]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]
    assert whitening.gram(y).tolist() == want
    model = whitening.Whitening(3, [int(c) for c in y.sum(axis=0)], np.zeros((0, 2)), np.zeros(0), 0.0)
    exact = [sum((3 * int(c) - int(s)) ** 2 for c, s in zip(r, y.sum(axis=0))) for r in y]
    assert [int(d) for d in whitening.deviations(model, y).to_pylist()] == exact
