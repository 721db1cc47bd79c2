"""Corpus operators against brute force on small tables with nulls, repeats, ties, long texts and clashing columns."""

from __future__ import annotations

import base64
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tradelattice.llm import (
    bpe, collision_search, decontamination, interpolated_lm, licenses, near_duplicates, quality, subwords, toxicity, warc, wordpiece,
)
from tradelattice.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
RNG = random.Random(5)


def prose(count: int, rng: random.Random = RNG) -> str:
    return " ".join("".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 7))) for _ in range(count))


def docs_of(spark, texts):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", None, 1, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "word", "Çà 中文   x", "a" * 30_000, (3, "word"), (None, "no id here"), "same text twice", "same text twice"]


# --- classifiers ---

def labelled(spark, bad_words, label):
    """A toxic document holds three bad words; one of low quality, a property of the whole text, a third of them."""
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(240):
        words = prose(rng.randint(20, 200), rng).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(3 if label == "toxic" else len(words) // 3):
                words[rng.randrange(len(words))] = rng.choice(bad_words) + rng.choice(["s", "ed", "ly", "!"])
        texts.append(" ".join(words))
        labels.append((i, None if i == 1 else int(not bad), None if i == 2 else int(bad)))
    labels += [(0, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_separates_held_out_documents(spark, operator, label):
    docs, labels, texts = labelled(spark, ["zgrumph", "qwaxlor"], label)
    rows = operator.score(docs, docs, labels, name="value").select("doc_id", "value").collect()
    assert len(rows) == len(texts)
    value = {r.doc_id: r.value for r in rows}
    held = [i for i in value if zlib.crc32(str(i).encode()) % 5 == 0]
    positive = [value[i] for i in held if (i % 3 == 0) == (label == "toxic")]
    negative = [value[i] for i in held if (i % 3 == 0) != (label == "toxic")]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    assert wins / (len(positive) * len(negative)) > 0.9


def test_classifier_odd_rows_and_missing_classes(spark):
    docs, labels = docs_of(spark, ODD), spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for operator, label in ((toxicity, "toxic"), (quality, "quality")):
        values = [r.value for r in operator.score(docs, docs, labels, name="value").collect()]
        assert len(values) == len(ODD) and all(0 <= v <= 1 for v in values)
        assert operator.score(docs, docs, labels.limit(0), name="value").select("value").distinct().collect()[0][0] == 0.5
        assert operator.score(docs.limit(0), docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_word_features_are_those_of_each_word_alone():
    words = ["a", "word", "Çà", "中文字", "x" * 500]
    flat, begins = subwords.word_features(words, subwords.Settings())
    for k, word in enumerate(words):
        alone, _ = subwords.word_features([word], subwords.Settings())
        assert sorted(flat[begins[k]:begins[k + 1]]) == sorted(alone)


# --- language model ---

def test_language_model_counts_and_base_by_brute_force(spark):
    rng = random.Random(2)
    vocabulary = prose(60, rng).split()
    texts = [" ".join(rng.choice(vocabulary[:rng.randint(5, 60)]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "UPPER upper ÄÖ", "same", "same"]
    rows = interpolated_lm.score(docs_of(spark, texts)).collect()
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in enumerate(texts)}
    held = {i for i in split if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, ws in split.items() if i not in held for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        ws = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
        assert math.isfinite(r.score) and r.score < 0


def test_language_model_is_a_distribution_and_learns_order(spark):
    texts = ["one two three four", "two three four one"] * 60
    rows = interpolated_lm.score(docs_of(spark, texts)).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.8
    one_word = {r.doc_id: r.score for r in interpolated_lm.score(docs_of(spark, ["a"] * 30 + ["b"] * 20 + [""] * 10)).collect()}
    assert sum(10 ** s for s in {one_word[0], one_word[30], one_word[55]}) <= 1 + 1e-9


def test_language_model_odd_rows(spark):
    rows = interpolated_lm.score(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD) and [r for r in rows if r.doc_id is None][0].held_out is False
    assert interpolated_lm.score(docs_of(spark, ODD).limit(0)).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    nothing = interpolated_lm.score(docs_of(spark, [(alone, "never learnt")])).collect()[0]
    assert (nothing.train_tokens, nothing.score, nothing.n_known) == (0, 0.0, 0)


# --- word pieces ---

def test_word_piece_counts_by_brute_force(spark):
    def greedy(pieces, word):
        at, count = 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
            if end is None:
                return -1
            at, count = end, count + 1
        return count

    rng = random.Random(3)
    for _ in range(300):
        pieces = {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = wordpiece.Automaton(pieces)
        for _ in range(40):
            word = "▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
            assert automaton.count(word) == greedy(pieces, word)
    vocabulary = wordpiece.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    known, texts = set(vocabulary), [prose(30), *[t for t in ODD if not isinstance(t, tuple)]]
    for r in wordpiece.with_counts(docs_of(spark, texts), vocabulary).collect():
        counts = [greedy(known, "▁" + w) if len(w) < 100 else None for w in (texts[r.doc_id] or "").split()]
        if None not in counts:
            assert tuple(r.pieces) == (len(counts), sum(max(c, 1) for c in counts), counts.count(-1))


# --- byte-level BPE ---

def test_byte_bpe_equals_the_merges_and_decodes(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [prose(200), "don't  stop\n\n 123-456 ***", "ßé 中文 🎉" * 30, *[t for t in ODD if not isinstance(t, tuple)]]
    rows = bpe.with_ids(docs_of(spark, texts), path, public_tokenizers.PATTERN, "ids", "decoded").withColumn("n", bpe.n_tokens("ids")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = other.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == expected and r.n == len(expected)
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_ids_decode_alone(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.with_ids(docs_of(spark, ["ßé 中文", "", None]), path, public_tokenizers.PATTERN).select("doc_id", "ids")
    coded = coded.unionByName(spark.createDataFrame([(9, None)], coded.schema))
    rows = coded.withColumn("out", bpe.decode(F.col("ids"), bpe.vocabulary(spark, path))).collect()
    assert {r.doc_id: None if r.out is None else bytes(r.out) for r in rows} == {0: "ßé 中文".encode(), 1: b"", 2: b"", 9: None}


def every_last(prefixes):
    return [prefixes.last_at(end) for end in range(1, len(prefixes.data) + 1)]


def test_prefixes_append_and_replace():
    vocabulary = bpe.Vocabulary.parse(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    rng = random.Random(4)
    for _ in range(40):
        text = prose(60, rng).encode()
        grown = bpe.Prefixes(vocabulary)
        for at in range(0, len(text), 7):
            grown.append(text[at:at + 7])
        assert every_last(grown) == every_last(bpe.Prefixes(vocabulary, text))
        start = rng.randrange(len(text))
        stop, new = min(len(text), start + rng.randint(0, 9)), prose(rng.randint(0, 2), rng).encode()
        worked = grown.replace(start, stop, new)
        fresh = bpe.Prefixes(vocabulary, text[:start] + new + text[stop:])
        assert (every_last(grown), bytes(grown.data), grown.tokens()) == (every_last(fresh), bytes(fresh.data), fresh.tokens())
        assert worked <= len(new) + 4 * vocabulary.longest or len(fresh.data) - start < 5 * vocabulary.longest


# --- near-duplicates ---

def brute_groups(texts, size):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_duplicates_by_brute_force(spark):
    rng, texts = random.Random(6), []
    for _ in range(12):
        base = prose(rng.randint(30, 120), rng).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = prose(1, rng)
            texts.append(" ".join(copy).title() if rng.random() < 0.3 else " ".join(copy))
    texts += [None, "", "word", "Word", "two words", "same text twice", "same text twice"]
    rows = near_duplicates.groups(docs_of(spark, texts), near_duplicates.Settings(words=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(texts, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_odd_rows(spark):
    docs = docs_of(spark, ODD)
    rows = near_duplicates.groups(docs).collect()
    assert len(rows) == len(ODD) and [r.kept for r in rows if r.doc_id is None] == [True]
    left = near_duplicates.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, 0, 1, 2, 3, 4, 5, 8]
    assert near_duplicates.groups(docs.limit(0)).count() == 0 and near_duplicates.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


# --- decontamination ---

def test_decontamination_finds_edited_items_and_no_others(spark):
    rng = random.Random(8)
    items = [prose(rng.randint(12, 50), rng) for _ in range(30)]
    texts, expected = [], set()
    for i in range(150):
        words = prose(rng.randint(5, 150), rng).split()
        if i % 2:
            k = rng.randrange(len(items))
            item = items[k].split()
            for _ in range(rng.randint(0, len(item) // 8)):
                item[rng.randrange(len(item))] = prose(1, rng)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in item]
            expected.add((i, k))
        texts.append(" ".join(words))
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    docs = docs_of(spark, texts)
    rows = decontamination.matches(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found <= expected and len(found) >= 0.97 * len(expected)
    for r in rows:
        words = [w.lower().strip(",") for w in texts[r.doc_id].split()][r.start_word:r.end_word]
        assert edit_distance(items[r.item_id].split(), words) == r.distance <= r.item_words // 5
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).collect()}
    assert kept == set(range(150)) - {i for i, _ in found}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def test_decontamination_odd_rows(spark):
    docs = docs_of(spark, [*ODD, (None, "alpha beta gamma delta epsilon zeta")])
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()] == [(None, 1)]
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.count() == len(ODD) and kept.columns == docs.columns
    assert decontamination.matches(docs, items.limit(0)).count() == 0 and decontamination.matches(docs.limit(0), items).count() == 0


def leaked(words, rng, percent=20):
    """``words`` with as many of them replaced as are allowed."""
    out = list(words)
    for k in rng.sample(range(len(words)), len(words) * percent // 100):
        out[k] = "".join(rng.choice("vwxyz") for _ in range(9))
    return out


def test_decontamination_screen_keeps_edited_neighbours():
    rng, settings = random.Random(6), decontamination.Settings()
    q, lost = decontamination.gram_size(60, settings), 0
    for _ in range(50):
        items = [prose(60, rng).split() for _ in range(3)]
        known = {tuple(x[k:k + q]) for x in items for k in range(61 - q)}
        text = prose(40, rng).split() + [w for x in items for w in leaked(x, rng)] + prose(40, rng).split()
        hits = np.array([tuple(text[k:k + q]) in known for k in range(len(text) - q + 1)], np.int64)
        lost += len({40, 100, 160} - set(decontamination.starts(hits, 60, settings).tolist()))
    assert lost == 0


@pytest.mark.parametrize("length", [8, 15, 60, 200])
def test_decontamination_misses_no_item_at_the_full_edits(spark, length):
    rng = random.Random(length)
    items = [prose(length, rng).split() for _ in range(40)]
    texts = [" ".join(prose(30, rng).split() + leaked(x, rng) + leaked(items[k - 1], rng) + prose(30, rng).split()) for k, x in enumerate(items)]
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = decontamination.matches(docs_of(spark, texts), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, i % 40) for k in range(40) for i in (k, k - 1)}
    assert {r.distance for r in rows} <= set(range(length // 5 + 1))


def test_decontamination_short_items_and_scripts_without_spaces(spark):
    chinese, thai = "中国的首都是哪座城市？请写出它的名字。", "เมืองหลวงของประเทศไทยคือเมืองอะไร"
    items = spark.createDataFrame(
        [(1, "What is 2+2?"), (2, chinese), (3, thai), (4, "zyzzyva"), (5, "two words"), (6, "...")], "item_id long, text string")
    docs = docs_of(spark, [
        "Tell me: what is 2 + 2", "what is 2 or 2", "问题：" + chinese.replace("哪座", "那座") + "谢谢", "ถาม" + thai + "ครับ", "ZYZZYVA.", "two new words",
        "中国的河流", "words, two words"])
    rows = decontamination.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows} == {(0, 1, 0), (2, 2, 1), (3, 3, 0), (4, 4, 0), (7, 5, 0)}


# --- nearest neighbours ---

def test_collision_search_recall_and_exact_scores(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 32)) * 2
    vectors = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 32))
    vectors[5] = vectors[7]  # a tie
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [None] * 32), (None, [1.0] * 32), (9100, [1.0, 2.0]), (9101, [1.0, 3.0])]
    table = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>")
    found = collision_search.search(table, F.col("vec_id") % 100 == 0, 10, collision_search.Settings(block_rows=700, block_queries=10))
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = 0
    assert set(got) == {*range(0, 3000, 100), 9100} and got[9100] == [(1.0, 9101)]
    for q in range(0, 3000, 100):
        exact = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort([np.arange(3000), exact]) if i != q][:10]
        hits += len(set(best) & {v for _, v in got[q]})
        assert got[q] == sorted(got[q]) and all(s == pytest.approx(exact[v]) for s, v in got[q])
    assert hits >= 0.95 * 300
    assert collision_search.search(table.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


# --- WARC ---

def test_warc_round_trip_and_revisits(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", "<p>é</p>", 0), (2, "http://b/", "x" * 200_000, 0), (3, "u\nv", "<p>é</p>", 0), (4, None, None, 0), (5, "e", "", 0),
         (6, "h", "WARC/1.1\r\n\r\nin a page", 0), (None, "n", "<p>é</p>", 0), (2, "http://b/", "x" * 200_000, 0)], "page_id long, url string, html string, record_type int")
    path = warc.archive(pages)
    rows = warc.read(spark, path).collect()
    kind = Counter((r.record_id, r.record_type, r.refers_to) for r in rows)
    assert kind == Counter([
        ("urn:page:1", "revisit", "urn:page:3"), ("urn:page:2", "response", None), ("urn:page:2", "response", None), ("urn:page:3", "response", None),
        ("urn:page:4", "revisit", "urn:page:5"), ("urn:page:5", "response", None), ("urn:page:6", "response", None), ("urn:page:none", "revisit", "urn:page:3")])
    payload = {r.record_id: r.payload for r in rows}
    assert payload["urn:page:3"].decode() == "<p>é</p>" and payload["urn:page:6"] == b"WARC/1.1\r\n\r\nin a page" and len(payload["urn:page:2"]) == 200_000
    assert payload["urn:page:1"] is None and {r.record_id: r.payload_bytes for r in rows}["urn:page:1"] == 9
    wanted = warc.read(spark, path).where((F.col("record_type") == "response") & F.col("record_id").isin("urn:page:3", "urn:page:6"))
    assert {r.record_id for r in wanted.collect()} == {"urn:page:3", "urn:page:6"}
    assert all(r.payload is None for r in warc.read(spark, path, payload=False).collect())
    assert warc.read(spark, warc.archive(pages.limit(0))).count() == 0


def test_warc_reads_plain_and_foreign_files(tmp_path, spark):
    import gzip

    def record(k):
        return warc.record_bytes({"record_id": f"urn:page:{k}", "record_type": "response", "target_uri": "u", "date": "d", "payload_digest": None,
                                  "payload_bytes": 3, "refers_to": None, "payload": b"abc"})

    (tmp_path / "a.warc").write_bytes(record(1) + record(2))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(3)) + gzip.compress(record(4)))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in rows) == [(f"urn:page:{k}", b"abc") for k in (1, 2, 3, 4)]


# --- licences ---

def test_license_scan_by_brute_force(spark):
    texts = [
        "Code. Released under the MIT License. More MIT  license!", "licensed under the APACHE License, Version 2.0 and so on",
        "general public\nlicense", "mit apache license", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "an agreement by an nc cc 4 0", "Permission is hereby granted, free of charge, to any person obtaining a copy",
        prose(300), *[t for t in ODD if not isinstance(t, tuple)],
    ]
    rows = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert [rows[i].labels for i in (0, 1, 2, 4, 5, 6, 7, 8)] == [
        "mit,mit-release", "apache,apache-2.0", "gpl", "gpl,gpl-3.0", "cc-by-nc-4.0", "", "mit-grant", ""]
    assert licenses.scan(docs_of(spark, ODD)).count() == len(ODD) and licenses.scan(docs_of(spark, ODD).limit(0)).count() == 0


def test_license_scan_keeps_every_notice_of_a_document(spark):
    single = {label: n.text for label, n in licenses.NOTICES.items()}
    combos = [c for k in (1, 2, 3) for c in itertools.combinations(single, k)] + [tuple(single)]
    data = ["gpl-3.0", "cc-by-nc-4.0", "mit-release", "apache-2.0"]
    combos += [tuple(data), tuple(data[::-1])]
    others = [prose(30) + " " + " ".join(licenses.VOCABULARY[k::5]) for k in range(5)]
    rows = licenses.scan(docs_of(spark, [". ".join(single[x] for x in c) for c in combos] + others)).collect()
    labels = {r.doc_id: set(r.labels.split(",")) for r in rows}
    assert [c for i, c in enumerate(combos) if labels[i] - set(licenses.MENTIONS.values()) != set(c)] == []


def test_license_scan_usual_headers(spark):
    texts = {
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl,gpl-2.0",
        "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "// SPDX-License-Identifier: MIT": "mit", "CC BY 4.0": "cc-by-4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
        "SPDX-License-Identifier: (MIT": "mit", "SPDX License Identifier": "",
    }
    rows = licenses.scan(docs_of(spark, list(texts))).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == list(texts.values())
