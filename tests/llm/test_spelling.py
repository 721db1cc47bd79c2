"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tradelattice.llm import queries, spelling

DOCS = "doc_id long, text string, word string, n string, near int"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def by_hand(rows, drop_one_in=199, shortest=6, fewest=5, factor=5):
    counts: Counter[str] = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drop_one_in and h % drop_one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    found = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        found[w] = (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return found


def texts(rng: random.Random):
    """A few base words by falling frequency, their variants, chains of variants, and many words of the same letters."""
    base = ["".join(rng.choice("abeinorstÀéüÿ") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words: list[str] = []
    for word in base:
        words += [word] * rng.choice([5, 30, 160, 900])
        for _ in range(6):
            at, letter = rng.randrange(len(word) + 1), rng.choice("abcxyz")
            variant = rng.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1:], word[:at] + letter + word[at + 1:]])
            words += [variant.title() if rng.random() < 0.3 else variant] * rng.choice([1, 5, 6, 27])
    letters = list("gardenist")
    for _ in range(120):
        rng.shuffle(letters)
        words += ["".join(letters)] * 5
    for a in "bcdfghjklmnpqrstvwxz":
        words += [f"cargol{a}", f"c{a}argol"] * 12
    words += ["chaina"] * 9 + ["chainab"] * 60 + ["chainabc"] * 400 + ["chainabcd"] * 2500
    rng.shuffle(words)
    cut = sorted(rng.randrange(len(words)) for _ in range(300))
    return [rng.choice([" ", ", ", "-", "\n", "ÿ1 "]).join(words[a:b]) for a, b in zip([0, *cut], [*cut, len(words)])]


@pytest.mark.parametrize("shared", [64, 3])
def test_variants_by_brute_force(spark, tmp_path, shared):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts(random.Random(6)))]
    rows += [(None, "orphan1 orphan orphan orphan orphan orphan", None, None, None), (5, None, None, None, None), (6, "", "", "", 0),
             (7, "repeat " * 9, "", "", 0), (7, "repeat " * 9, "", "", 0), (8, "a" * 40_000, "", "", 0), (9, "中文字中文字 ×÷×÷×÷ " * 6, "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    counts = spelling.word_counts(docs, spelling.Words(drop_one_in=199))
    found = spelling.variants(counts, spelling.Settings(shared=shared)).collect()
    want = by_hand([r[:2] for r in rows])
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == want and len(found) == len(want)
    assert any(w[4] != w[2] and w[2] for w in want.values()) and max(w[1] for w in want.values()) > 10
    if shared == 64:
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        rows = queries.QUERIES["op11_spelling"](spark, str(tmp_path)).collect()
        assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == want


def test_deletions_follow_the_rule(spark):
    rows = [(i, "elephant elephant giraffe" if i % 2 else "crocodile") for i in range(900)]
    got = spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), spelling.Words(drop_one_in=19, fewest=1)).collect()
    assert {r.word: r.n for r in got} == {w: v[0] for w, v in by_hand(rows, drop_one_in=19, fewest=1).items()} and len(got) > 10
    plain = spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.word: r.n for r in plain} == {"elephant": 900, "giraffe": 450, "crocodile": 450}


def test_signatures_meet_within_two_places(spark):
    """Every pair of words one edit apart shares a signature, and if it is refined a half."""
    rng = random.Random(8)
    pairs = []
    for _ in range(400):
        word = "".join(rng.choice("aabcdeéÿ") for _ in range(rng.randint(2, 12)))
        at = rng.randrange(len(word))
        pairs.append((word, rng.choice([word[:at] + "z" + word[at:], word[:at] + word[at + 1:], word[:at] + "z" + word[at + 1:], word + "z"])))
    rows = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    keys = [F.arrays_overlap(spelling.signatures(F.col("a"), 7), spelling.signatures(F.col("b"), 7)).alias("sign"),
            F.arrays_overlap(spelling.refined(F.col("a"), F.length("a")), spelling.refined(F.col("b"), F.length("b"))).alias("half")]
    assert all(r.sign and r.half for r in rows.select(*keys).collect())


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "1 2 3")], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(nothing)).count() == 0
