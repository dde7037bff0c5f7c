"""Personal data, decontamination, quality, packing, training order and files."""

import hashlib
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from llm_fixtures import docs, prose  # noqa: F401
from plumbline.llm import decontaminate, html_extract, packing, pii, quality, tokens, training_order, warc
from plumbline.llm.tagger import Tagger
from plumbline.llm.tokens import default_vocabulary, encoder
from plumbline.sources.shared import scratch_path


def _plain_spans(text):
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        r"[0-9](?:[\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    out = []
    for kind, pattern in enumerate(patterns):
        for found in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", found[0])
            if kind == 1 and any(int(p) > 255 for p in found[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and pii._luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((found.start(), kind, found.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    alphabet = list("aZ9.0-@+ ()_%\n1é") + ["4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "a.b@c.de", "+49 (30) 123-4567"]
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 25)))
        assert pii.base_spans(text) == _plain_spans(text), text


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + "9" * 300_000 + "@" * 1000) == []


def test_tagger_slopes_and_learning():
    tagger, rng = Tagger(2, width=4, hidden=3), np.random.default_rng(0)
    x, y = rng.integers(0, 20, (3, 6)), np.array([[0, 1, 2, 2, 0, 3], [0] * 6, [3, 4, 4, 0, 1, 2]])
    _, slopes = tagger.gradients(x, y)
    for name, value in tagger.p.items():
        at = tuple(int(rng.integers(0, size)) for size in value.shape)
        kept = value[at]
        value[at] = kept + 1e-5
        up, _ = tagger.gradients(x, y)
        value[at] = kept - 1e-5
        down, _ = tagger.gradients(x, y)
        value[at] = kept
        assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-5
    before, _ = tagger.gradients(x, y)
    tagger.fit(x, y, epochs=400, rate=0.05)
    assert tagger.gradients(x, y)[0] < before / 4


def test_windows_own_every_character():
    text = "x" * 40 + "1" * 500 + "y" * 90 + "@" + "z" * 30
    owned = sorted(k for _, _, first, last in pii._windows(text) for k in range(first, last))
    assert len(owned) == len(set(owned)) and all(text[k] in "xyz" or k in set(owned) for k in range(len(text)))


def test_personal_data(docs):
    rows = [(k, f"write to user{k}@mail{k % 7}.org or call +49 30 1234{k:04d} now") for k in range(60)]
    rows += [(100, None), (101, ""), (102, "mail jane.doe[at]host[dot]org please"), (103, "plain words only")]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(*rows)).collect()}
    assert got[3]["n_email"] == 1 and got[3]["n_phone"] == 1
    for i, text in rows:
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in _plain_spans(text or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert got[100]["spans"] == got[103]["spans"] == ""
    assert pii.personal_data(docs().limit(0)).count() == 0


def test_suffix_order_and_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(0, 12, rng.integers(1, 8))
        hashes = rng.integers(1, 5, lengths.sum()).astype(np.uint64)
        index = decontaminate.Index.build(hashes, lengths)
        size = 3
        phrases = np.array([rng.integers(1, 6, size) for _ in range(20)]).astype(np.uint64)
        which, low, high = index.search(phrases, np.full(20, size))
        found = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(which, low, high)}
        text, at = [], 0
        for n in lengths:
            text += [*hashes[at : at + n].tolist(), 0]
            at += n
        for p, phrase in enumerate(phrases.tolist()):
            places = [i for i in range(len(text) - size + 1) if text[i : i + size] == phrase]
            assert found.get(p, []) == places


def test_contamination(spark, docs, prose):
    item = prose(9, 14)
    bench = spark.createDataFrame([(1, item), (2, "Tiny item"), (2, "Tiny item"), (3, None), (None, "lone"), (4, "...")], "item_id long, text string")
    inside = item.upper().replace(" ", ", ")
    frame = docs(
        (1, f"before {inside} after"), (2, "a tiny-ITEM, a tiny item"), (3, prose(8)), (4, None), (5, ""), (6, "lone"),
        (7, " ".join(item.split()[:9])), (1, f"before {inside} after"),
    )
    rows = decontaminate.contamination(frame, bench).collect()
    assert len(rows) == 8
    got = {r["doc_id"]: r for r in rows}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (16, 14, 1)
    assert (got[2]["n_words"], got[2]["n_hit"], got[2]["items_sha256"]) == (6, 4, hashlib.sha256(b"2").hexdigest())
    assert got[6]["contaminated"] and got[6]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert not any(got[i]["contaminated"] for i in (3, 4, 5, 7)) and got[5]["n_words"] == 0
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(frame, bench).collect()} == {3, 4, 5, 7}
    assert not any(r["contaminated"] for r in decontaminate.contamination(frame, bench.limit(0)).collect())
    assert decontaminate.contamination(docs().limit(0), bench).count() == 0


def test_contamination_in_blocks(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    monkeypatch.setattr(decontaminate, "BLOCKS_PER_PASS", 2)
    bench = spark.createDataFrame([(k, prose(k, 15)) for k in range(4)], "item_id long, text string")
    rows = decontaminate.contamination(docs(*[(k, "x " + prose(k, 15)) for k in range(6)]), bench).collect()
    assert sorted((r["doc_id"], r["n_hit"]) for r in rows) == [(0, 15), (1, 15), (2, 15), (3, 15), (4, 0), (5, 0)]


def test_quality(spark, docs, prose):
    rows = [(k, prose(k)) for k in range(150)] + [(k, " ".join(w.upper() + "!!" for w in prose(k).split())) for k in range(150, 200)]
    rows += [(300, None), (301, "")]
    labels = spark.createDataFrame(
        [(k, int(k < 150), 0) for k in range(0, 200, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"
    )
    got = {r["doc_id"]: r for r in quality.quality_scores(docs(*rows), labels).collect()}
    assert len(got) == 202 and all(0 <= r["score"] <= 1 for r in got.values())
    right = [got[k]["predicted"] == int(k < 150) for k in range(200)]
    assert sum(right) >= 195
    assert got[7]["held_out"] == (zlib.crc32(b"7") % 3 == 1)
    kept = quality.keep_quality(docs(*rows), labels)
    assert sum(r["doc_id"] < 150 for r in kept.collect()) >= 148 and kept.columns[:2] == ["doc_id", "text"]
    assert all(r["score"] == 0.5 for r in quality.quality_scores(docs((1, "a")), labels.limit(0)).collect())
    assert quality.quality_scores(docs().limit(0), labels).count() == 0


TRICKY = ["", "  a  b ", "<|endoftext|> x", "ab<|startoftext|>c", "it's I'LL", "ÀÉß'd a×b ½ ª", "\x0bq\x0cz", "a\x1cb\x85d", "İΣ ΑΣ", "é ́x", "😀日本", "a\tb\r\n"]


def test_token_ids_are_the_tokenizers():
    encode = encoder(default_vocabulary())
    for text in TRICKY:
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


_TASKS = """
import gc, pickle, sys, weakref
gc.disable()
raw, old = sys.stdin.buffer.read(), []
for _ in "abc":
    encode = pickle.loads(raw)(sys.argv[1])
    encode("it's a text")
    old.append(weakref.ref(encode))
    del encode
assert not any(ref() for ref in old)
"""


def test_encoders_do_not_outlive_their_tasks():
    """Each task unpickles the package anew; what it cached is freed with it, without the garbage collector."""
    subprocess.run([sys.executable, "-c", _TASKS, default_vocabulary()], input=cloudpickle.dumps(encoder), check=True, timeout=60)


def test_distinct_parts_are_encoded_once_and_bounded(monkeypatch):
    """Over slices of texts, each part goes through the model once while it is kept; ids are the tokenizer's."""
    encode, made = tokens.Encoder(default_vocabulary()), []
    monkeypatch.setattr(encode, "_part", lambda part, make=encode._part: made.append(part) or make(part))
    texts = [*TRICKY, None, "a,b " * 40 + "Été! " * 9, "x" * 200, "日本 a,b été"] * 3
    want = [encode.tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]
    for size in (1 << 20, 60):
        monkeypatch.setattr(tokens, "SLICE", size)
        assert [np.frombuffer(raw, "<u4").tolist() for raw in encode.each(pa.array(texts))] == want
    short = [part for part in made if len(part) <= tokens.CACHED_LENGTH]
    assert len(short) == len(set(short)) and "x" * 200 not in encode.parts
    monkeypatch.setattr(tokens, "CACHED_PARTS", 20)
    for k in range(30):
        (raw,) = encode.each(pa.array([f"w{'abcdefghij'[k % 10]}{'klm'[k // 10]} same"]))
        assert len(encode.parts) <= 20 + 2
    assert [np.frombuffer(raw, "<u4").tolist() for raw in encode.each(pa.array(texts))] == want


@pytest.mark.parametrize("count", [0, 1, 30, 400])
def test_packing(docs, prose, count):
    rows = [(k, prose(k, 5 + 11 * k % 700)) for k in range(count)] + ([(9000, None), (9001, "")] if count else [])
    frame = docs(*rows) if rows else docs().limit(0)
    pieces = packing.pack(frame.coalesce(1)).collect()
    encode = encoder(default_vocabulary())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for i, text in rows:
        ids, at = np.frombuffer(encode(text or ""), "<u4").tolist() + [2], 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = tokens = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        size = 0
        for p in parts:
            assert p["offset"] == size
            size += p["length"]
        assert size <= 4096
        tokens, padding = tokens + size, padding + (0 if size & (size - 1) == 0 else 4096 - size)
    assert padding <= 0.01 * tokens


def test_permutation():
    for size in (1, 2, 3, 7, 64, 1000):
        assert sorted(training_order.permuted(np.arange(size), size).tolist()) == list(range(size))
    assert (training_order.permuted(np.arange(1000), 1000, 1) != training_order.permuted(np.arange(1000), 1000, 2)).any()


def test_training_order(spark, docs, prose):
    folder = scratch_path(spark, "shards")
    rows = [(k, prose(k, 90)) for k in range(30)] + [(100, None)]
    table = training_order.materialise(docs(*rows), folder, length=32, per_shard=50).collect()
    assert sorted(r["slot"] for r in table) == list(range(len(table)))
    by_slot = {r["slot"]: r for r in table}
    for slot, ids in zip(range(3, len(table)), training_order.read_slots(folder, 3, len(table), 32, 50)):
        r = by_slot[slot]
        assert len(ids) == 32 and zlib.crc32(ids[: r["n_tokens"]].tobytes()) == r["ids_crc32"]
    assert training_order.materialise(docs().limit(0), scratch_path(spark, "none")).count() == 0


def test_sequences_travel_in_blocks(tmp_path):
    """A batch sends a row per shard, smaller than its ids, and the shards get all of it; null ids stay null."""
    sizes = [1, 700, 64, 0, 333] * 40
    texts = [np.arange(k, dtype="<u2") % 50 for k in sizes if k]
    numbers = np.cumsum([0, *(-(-len(t) // 32) for t in texts)])
    total, ids = int(numbers[-1]), [None if k % 7 == 0 else k for k in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "number": numbers[:-1], "ids": pa.array([t.tobytes() for t in texts], pa.binary())})
    (sent,) = training_order._placed(total, 1, 32, 1000)(iter([batch]))
    assert sent.num_rows == -(-total // 1000) and sum(sent.column("n").to_pylist()) == total
    assert sum(map(len, sent.column("block").to_pylist())) < sum(t.nbytes for t in texts) / 2
    rows = []
    for k in range(sent.num_rows):
        for part in training_order._write(str(tmp_path), total, 32, 1000)(iter([sent.slice(k, 1)])):
            rows += part.to_pylist()
    assert [r["slot"] for r in rows] == list(range(total))
    read = list(training_order.read_slots(str(tmp_path), 0, total, 32, 1000))
    pieces = {(k, i): t[i * 32 : i * 32 + 32] for k, t in enumerate(texts) for i in range(-(-len(t) // 32))}
    where = {int(slot): (k, i) for k, t in enumerate(texts) for i in range(-(-len(t) // 32)) for slot in training_order.permuted(np.array([numbers[k] + i]), total, 1)}
    for r, got in zip(rows, read):
        k, i = where[r["slot"]]
        assert (r["doc_id"], r["piece"], r["n_tokens"]) == (ids[k], i, len(pieces[k, i]))
        assert (got[: r["n_tokens"]] == pieces[k, i]).all() and not got[r["n_tokens"] :].any()
        assert r["ids_crc32"] == zlib.crc32(pieces[k, i].tobytes())


def test_archives(spark):
    big = "<p>" + "é" * 80
    rows = [(5, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "tiny"), (1, "u", "tiny"), (4, "u", None), (2, "http://a/2\r\nX: y", big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(pages, folder)
    got = warc.read_archives(index, folder).collect()
    found = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got)
    size = len(big.encode())
    assert found == [
        (0, "revisit", 2, size), (1, "response", 0, 4), (2, "response", 0, size), (2, "response", 0, size),
        (3, "response", 0, 4), (4, "response", 0, 0), (5, "revisit", 2, size),
    ]
    digest = hashlib.sha256(big.encode()).hexdigest()
    assert {r["payload_digest"] for r in got if r["payload_bytes"] == size} == {digest}
    only = warc.read_archives(index.where("page_id = 3"), folder).collect()
    assert [(r["page_id"], r["payload_bytes"]) for r in only] == [(3, 4)]
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


PAGE = (
    '<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/x>Menu</a></ul></nav>'
    '<div class="ad">Buy {n}</div><article><h1>Head {n}</h1><p><b>First &amp; {n}.<br><p>Second\n  text {n}.</p><p>Share this page</p>'
    '<section class="comments"><p>nice {n}</p></section><form><p>Mail</p></form></article><aside>More</aside><footer>&copy; {n}</footer>'
)


def test_html(spark):
    rows = [(n, "http://h.org/%d" % n, PAGE.replace("{n}", f"item{n}")) for n in range(8)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://k.org", "<p>Only <i>one</i>&nbsp;block"), (23, "http://k.org", "<div>" * 3000 + "deep")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Head item3\nFirst & item3.\nSecond text item3."
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "Only one block" and got[23]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_copies_are_not_template(spark):
    page = PAGE.replace("{n}", "same").replace("<p>Share this page</p>", "")
    rows = [(n, "http://h.org/", page) for n in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    assert {r["text"] for r in html_extract.extract(frame).collect()} == {"Head same\nFirst & same.\nSecond text same."}


@pytest.mark.parametrize("tag", ["svg", "math", "object", "select", "template", "noscript"])
def test_html_unclosed_elements_lose_no_text(spark, tag):
    pages = [
        (1, f"<p>Before.</p><{tag}><p>Between.</p><p>After.</p>"),
        (2, f"<{tag}><article><p>Before.</p><p>Between.</p><p>After.</p></article>"),
        (3, f"<p>Before.</p><{tag}><{tag}>x</{tag}>y</{tag}><p>After.</p>"),
        (4, "<div><p>So <a href=x>much of it is linked</a>.</p></div>"),
    ]
    rows = [(i, f"http://h{i}.org/", page) for i, page in pages]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "Before.\nBetween.\nAfter."
    assert got[3] == ("Before.\nxy\nAfter." if tag in ("math", "object") else "Before.\nAfter.")
    assert got[4] == "So much of it is linked."


def _html_texts(frame):
    return {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}


def test_html_constant_among_many_paragraphs(spark):
    rows = []
    for n in range(12):
        own = [f"<p>Own {n} {k}.</p>" for k in range(9 + n % 3)]
        # One text is on every page, one on 7 of 12, one on 5 of 12.
        own[2:2] = ["<p>All.</p>"] + ["<p>Most.</p>"] * (n < 7) + ["<p>Some.</p>"] * (n >= 7)
        rows.append((n, "http://h.org/", "<article>" + "".join(own) + "</article>"))
    got = _html_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    for n in range(12):
        own = [f"Own {n} {k}." for k in range(9 + n % 3)]
        own[2:2] = ["Some."] * (n >= 7)
        assert got[n].split("\n") == own


def test_html_ties_over_the_node_limit_stay(monkeypatch):
    monkeypatch.setattr(html_extract, "NODES", 5)
    root = html_extract.loaded(["", [["p", []] for _ in range(9)]])
    assert len(html_extract._pruned(root).children) == 4


def test_html_copies_count_once_for_any_split(spark):
    def page(*texts):
        return "<article>" + "".join(f"<p>{text}</p>" for text in texts) + "</article>"

    # Half of ten distinct pages and the copied one have "Boiler."; "Shared." is on two and the copies.
    rows = [(n, page(*["Boiler."] * (n < 6), f"Own {n}.", *["Shared."] * (n in (3, 8)), f"End {n}.")) for n in range(10)]
    rows += [(100 + k, page("Copied one.", "Shared.", "Copied two.")) for k in range(60)]
    rows = [(i, "http://h.org/", text) for i, text in rows]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 3, 9):
        got = _html_texts(frame.repartition(parts))
        assert got[3] == "Own 3.\nShared.\nEnd 3." and got[8] == "Own 8.\nShared.\nEnd 8." and got[0] == "Own 0.\nEnd 0."
        assert got[100] == got[159] == "Copied one.\nShared.\nCopied two."


def test_contamination_spans_are_the_same_in_one_pass_and_in_several(spark, docs, prose, monkeypatch):
    bench = spark.createDataFrame([(k, prose(k, 40)) for k in range(3)], "item_id long, text string")
    rows = [(0, prose(0, 40) + " apart " + prose(1, 40)), (1, "x " + prose(2, 40)), (2, prose(0, 30) + " " + prose(1, 35)), (3, "clean"), (4, None)]
    once = {r["doc_id"]: tuple(r) for r in decontaminate.contamination(docs(*rows), bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    monkeypatch.setattr(decontaminate, "BLOCKS_PER_PASS", 2)
    several = {r["doc_id"]: tuple(r) for r in decontaminate.contamination(docs(*rows), bench).collect()}
    assert several == once and once[0][2] == 80 and once[0][-1].count("start") == 2 and once[2][-1].count("start") == 1


def test_html_texts_beyond_the_template_are_counted(spark):
    """Pages of more nodes than a template keeps: what all of them share goes, wherever it stands."""
    sections, blocks = 46, 50
    assert sections * blocks > html_extract.NODES

    def page(i):
        def text(s, b):
            return f"Shared {s}." if b == 7 else f"Block {b} of {s} on page {i}."

        inner = ("".join(f'<div class="b{b}">{text(s, b)}</div>' for b in range(blocks)) for s in range(sections))
        return "<body>" + "".join(f'<section class="s{s}">{part}</section>' for s, part in enumerate(inner)) + "</body>"

    frame = spark.createDataFrame([(i, "http://h/", page(i)) for i in range(5)], "page_id long, url string, html string")
    for row in html_extract.extract(frame).collect():
        lines = row["text"].split("\n")
        assert len(lines) == sections * (blocks - 1) and all(line.endswith(f"on page {row['page_id']}.") for line in lines)
