"""License candidates and phrases, random-walk keys, clashing names, empty and odd inputs of operators and the pipeline."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradelattice.llm import bpe, decontamination, licenses, near_duplicates, subwords, wordpiece
from tradelattice.session import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, 1, 0.5, "x") for i, t in enumerate(texts)], DOCS)


def prose(count, rng):
    return " ".join("".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 7))) for _ in range(count))


# --- licenses ---

def words_of(text):
    return [w for w in re.split(licenses.SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def by_hand(texts, settings):
    """(labels, score) of every text, from all beginnings of all notices."""
    held = [set(words_of(t)) for t in texts]
    counts = {w: sum(w in h for h in held) for w in licenses.VOCABULARY}
    rare = {w: math.log((len(texts) + 1) / (counts[w] + 1)) + 1e-6 for w in licenses.VOCABULARY}
    found = []
    for text in texts:
        words, labels, score = words_of(text), set(), 0.0
        for phrase, label in licenses.MENTIONS.items():
            if any(words[k:k + len(phrase.split())] == phrase.split() for k in range(len(words))):
                labels.add(label)
                score = 0.5
        best = 0.0
        for label, notice in licenses.FORMS:
            own, key = words_of(notice.text), words_of(notice.key)
            sure = sorted(sorted(set(key)), key=lambda w: -rare[w])[:settings.agreeing]
            top = sorted(sorted(set(own)), key=lambda w: -rare[w])[:settings.lookups]
            top = sure + [w for w in top if w not in sure and counts[w] <= settings.common * len(texts)]
            key_at = next(k for k in range(len(own)) if own[k:k + len(key)] == key)
            for begin in range(-len(own), len(words)):
                agree = {w for k, w in enumerate(own) if w in top and 0 <= begin + k < len(words) and words[begin + k] == w}
                share = sum(rare[w] for w in agree) / sum(rare[w] for w in top)
                near = range(begin + key_at - settings.slack, begin + key_at + settings.slack + 1)
                if len(agree) >= settings.agreeing and share >= settings.least_share and any(k >= 0 and words[k:k + len(key)] == key for k in near):
                    labels.add(label)
                    best = max(best, min(share, 1.0))
        found.append((",".join(sorted(labels)), best or score))
    return found


def notice_texts(rng):
    texts = [prose(rng.randint(0, 80), rng) for _ in range(60)] + [None, "", "license", "mit license"]
    for _ in range(70):
        parts = []
        for _, notice in rng.sample(licenses.FORMS, rng.randint(1, 3)):
            words = notice.text.split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randint(0, 1)] = rng.choice([[], [prose(1, rng)]])
            parts += [" ".join(words), prose(rng.randint(0, 30), rng)]
        texts.append(". ".join(parts))
    return texts


@pytest.mark.parametrize("settings", [licenses.Settings(), licenses.Settings(lookups=4, common=0.5, agreeing=3, slack=0)])
def test_licenses_by_brute_force(spark, settings):
    texts = notice_texts(random.Random(12))
    rows = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts), settings).collect()}
    for i, (labels, score) in enumerate(by_hand(texts, settings)):
        assert rows[i].labels == labels and rows[i].score == pytest.approx(score), texts[i]
    assert sum(r.score > 0.5 for r in rows.values()) > 40


def test_the_index_proposes_and_the_phrase_decides(spark):
    """Words of a notice at their places make a candidate; without the mandatory phrase it comes to nothing."""
    texts = ["Released under the MIT License", "Released under the MIT style License", "a license released by mit people", prose(20, random.Random(1))] * 3
    docs, settings = docs_of(spark, texts), licenses.Settings()
    index = licenses.Index.of(*licenses.frequencies(docs), settings)
    scanned = stage(licenses.with_hits(docs, index).withColumn("row", F.col("doc_id").cast("string")), "scanned")
    found = stage(licenses.candidates(scanned, index, settings), "candidates")
    form = next(k for k, (label, _) in enumerate(licenses.FORMS) if label == "mit-release")
    proposed = {int(r.row) % 4 for r in found.where(F.col("form") == form).collect()}
    proven = {int(r.row) % 4 for r in licenses.proven(found, scanned, settings).where("label = 'mit-release'").collect()}
    assert proposed >= {0, 1} and proven == {0}
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


# --- random walks ---

@pytest.mark.parametrize("length", [3, 8, 15, 60, 200, 400])
def test_walk_keys_reach_the_target_recall(length):
    """Edited copies of items drawn anew meet as often as the number of walks was chosen for, but for chance."""
    for percent in (10, 20):
        settings = decontamination.Settings(percent=percent)
        rng = np.random.default_rng(length * percent)
        items = rng.integers(1, 2 ** 62, (150, length)).astype(np.uint64)
        k = decontamination.edits(length, settings)
        others = np.stack([decontamination.edited(w, k, rng)[:length] for w in items])
        walks = decontamination.needed_walks(length, settings)
        met = (decontamination.walk_keys(items, walks, settings) == decontamination.walk_keys(others, walks, settings)).any(axis=1).mean()
        assert met >= (0.8 if walks < settings.walks else 0.5), (length, percent, walks, met)
        foreign = rng.integers(1, 2 ** 62, (150, length)).astype(np.uint64)
        assert (decontamination.walk_keys(items, walks, settings) == decontamination.walk_keys(foreign, walks, settings)).mean() < 0.02
        if not k:
            assert walks == 1 and met == 1.0


def test_walks_find_pairs_and_grams_complete_them(spark):
    rng = random.Random(21)
    items = [prose(40, rng).split() for _ in range(60)]
    texts = []
    for item in items:
        words = list(item)
        for at in rng.sample(range(40), 8):
            words[at] = "".join(rng.choice("vwxyz") for _ in range(9))
        texts.append(prose(25, rng) + " " + " ".join(words) + " " + prose(25, rng))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = decontamination.matches(docs_of(spark, texts), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, k) for k in range(60)}
    assert 0.7 < sum(r.by_walk for r in rows) / 60
    few = decontamination.matches(docs_of(spark, texts), benchmark, settings=decontamination.Settings(walks=1)).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in few} == {(r.doc_id, r.item_id, r.distance) for r in rows}
    assert sum(r.by_walk for r in few) < sum(r.by_walk for r in rows)


def test_rows_that_repeat_an_id_are_each_looked_at(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta eta"), (7, "one two three four five six seven")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, benchmark).collect()} == {(7, 1), (7, 2)}


# --- names, empty tables, odd rows ---

def test_columns_with_clashing_names_come_back(spark):
    rows = [(1, "one two three four five six", "a", 1, None), (2, "one two three four five six", "b", 2, {"k": 1}), (3, "other words altogether in here now", "c", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept_id string, _row_name long, _place map<string,int>")
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r._kept_id) for r in kept.collect()} == {(1, "a"), (3, "c")}
    items = spark.createDataFrame([(1, "other words altogether in here now")], "item_id long, text string")
    clean = decontamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and {(r.doc_id, r._row_name) for r in clean.collect()} == {(1, 1), (2, 2)}
    for taken in ("ids", "DECODED"):
        with pytest.raises(ValueError, match="there already"):
            bpe.with_ids(docs.withColumn(taken, F.lit(1)), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "ids", "decoded")
    with pytest.raises(ValueError, match="there already"):
        wordpiece.with_counts(docs.withColumn("pieces", F.lit(1)), ["a"])


def test_of_repeated_ids_the_same_row_stays(spark):
    rows = [(1, f"text number {k} of the same id", k) for k in range(20)] + [(1, "text number 3 of the same id", 99)]
    found = {tuple(near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(k)).collect()[0]) for k in (1, 3, 7)}
    assert len(found) == 1
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    learnt = {subwords.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(k), labels, "toxic", 5, subwords.Settings()).collect()[0].text
              for k in (1, 3, 7)}
    assert len(learnt) == 1


def test_empty_tables(spark):
    docs = docs_of(spark, ["x"]).limit(0)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.with_ids(docs, path, public_tokenizers.PATTERN).count() == 0
    assert wordpiece.with_counts(docs, ["a"]).count() == 0


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows, and columns whose names the stages use themselves."""
    folder, rng = tmp_path_factory.mktemp("odd"), random.Random(2)
    texts = [prose(rng.randint(30, 90), rng) for _ in range(60)]
    texts += [None, "", " \n", texts[0], texts[1] + " more", "word " * 20_000, "中文 " * 50]
    item = prose(30, rng)
    texts += [prose(40, rng) + " " + item + " " + prose(40, rng)]
    rows = [(i, t, None if i % 5 == 0 else "en", None, "k", "i", 1.5) for i, t in enumerate(texts)]
    rows += [(None, "no id but a text", None, None, None, None, None), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, _kept_id string, _row_name string, _toxicity double"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(i % 2), int(i % 7 == 0)) for i in range(60)] + [(None, 1, 1), (61, None, None), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_pipeline_of_odd_rows(spark, odd_folder):
    docs = step = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, step, odd_folder)
        assert after.columns == docs.columns
        step = stage(after, "odd")
    rows = corpus_pipeline.run(spark, odd_folder).collect()
    assert len(rows) == step.count() and all(r.n_tokens * 4 == len(r.ids) for r in rows)


def test_pipeline_of_no_rows(spark, odd_folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_small_caches_change_no_ids():
    """Every cache of the encoder may forget at any time."""
    content, rng = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), random.Random(14)
    own, small = bpe.Encoder(content, public_tokenizers.PATTERN), bpe.Encoder(content, public_tokenizers.PATTERN)
    for cache in (small, small.vocabulary.steps, small.vocabulary.apart):
        cache.most = 3
    parts = ["word", "Of", "it's", "'ll", "12", "...", "!", "中文", "é", "😀", " ", "  ", "\n", "\u00a0", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    assert all(own.ids(t) == small.ids(t) for t in texts) and len(small) <= 3
    with pytest.raises(ValueError, match="every byte"):
        bpe.Vocabulary({b"a": 0, b"b": 1})
