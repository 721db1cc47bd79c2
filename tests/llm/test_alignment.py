"""Alignment of tokenizers against whole texts encoded at once."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tradelattice.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, block string, part int, groups string, pair double"
ODD = [
    None, "", " ", "  ", "\n", "word", " lead", "trail ", "trail  ", "a  b   c", "tabs\tand\n lines \n\n end", "Çà 中文   字 x", "😀 a😀b 👨‍👩‍👧",
    "① ﬁ ½", "▁ mark", "a▁b", "in ▁", "<s> </s> <|endoftext|> <0x0A> <unk>", "a" * 30_000, "中" * 3_000, "it's we'll THEY'RE", "nul\x00 \x1c \x85 x  y",
    "᠎ z", "é" * 50 + " é " * 20, "same text twice", "same text twice",
]


def by_hand(texts):
    """Rows as the contract words them, from each text encoded whole: token bytes, their ends, groups, and all overlaps."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    symbol = alignment.byte_of_symbol()
    cut, linked = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        sides = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            sides.append([(i, bytes(symbol[c] for c in a.id_to_token(i))) for i in ids])
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            sides.append([(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in pieces])
        if not text or any(b"".join(x for _, x in side) != whole for side in sides):
            cut.append(([], []))
            linked.append([])
            continue
        placed = []
        for side in sides:
            at, found = 0, []
            for i, x in side:
                found.append((i, at, at + len(x)))
                at += len(x)
            placed.append(found)
        cut.append(tuple(placed))
        links, j = [], 0
        for i, begin, end in placed[0]:
            while placed[1][j][2] <= begin:
                j += 1
            k = j
            while k < len(placed[1]) and placed[1][k][1] < end:
                links.append((i, placed[1][k][0]))
                k += 1
        linked.append(links)
    counts = Counter(x for links in linked for x in links)
    best: dict[int, int] = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    rows = []
    for (left, right), links in zip(cut, linked):
        ends = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, _, e in side if begin < e <= end) for side in (left, right)))
            begin = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""
        rows.append((len(left), len(right), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return rows


def rows_of(spark, texts, tmp_path):
    rows = [(i, t, "x", 1, "y", 0.5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.QUERIES["op12_alignment"](spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    return [tuple(found[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for i in range(len(texts))]


def test_alignment_by_hand(spark, tmp_path):
    rng = random.Random(4)
    parts = "the a Of ing étion 中文 字 ñ ß 😀 é ▁ \n \t , . 's 12 3456 -- <s> ¼   x y".split(" ") + [" ", "  ", "\n\n"]
    texts = ODD + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert rows_of(spark, texts, tmp_path) == by_hand(texts)


def pair_counts(rows):
    return Counter({int(p): int(n) for r in rows if r["kind"] == alignment.PAIRS for p, n in zip(r["ids"], r["counts"])})


def test_small_blocks_give_the_same(monkeypatch):
    """Blocks of one text each, that carry segments on or don't, count what one block counts; rows stay small."""
    own = alignment.Aligner(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    monkeypatch.setattr(alignment, "NUMBERS_IN_ROW", 3)
    texts = [t for t in ODD if t and len(t) < 100]
    many = alignment.Block(own)
    many.add(list(range(len(texts))), texts)
    rows = list(many.rows())
    assert all(len(r["ids"]) <= 3 for r in rows if r["kind"] == alignment.PAIRS)
    for carried in (0, 2, 100):
        monkeypatch.setattr(alignment, "CARRIED", carried)
        total, block = Counter(), alignment.Block(own)
        for text in texts * 2:
            block.add([1], [text])
            total.update(pair_counts(block.rows()))
            block = block.following()
            assert len(block.known) <= carried and not block.ids
        assert +total == Counter({p: 2 * n for p, n in pair_counts(rows).items()})


def test_spans_refine_characters_and_bytes():
    own = alignment.Aligner(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    for text in ("中文字", "①", "é 😀", "plain words"):
        a_ids, a_ends, b_ids, b_ends = own.tokens(" " + text)
        for ids, ends, known in ((a_ids, a_ends, own.a_bytes), (b_ids, b_ends, own.b_bytes)):
            lengths = [len(known[i]) for i in ids]
            assert ends.tolist() == [sum(lengths[:k + 1]) for k in range(len(lengths))]
    assert own.segmented
    assert own.tokens(" a▁b") is None


def test_empty_table_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "no id here"), (None, None)], "doc_id long, text string")
    rows = alignment.align(docs, *PATHS).collect()
    assert len(rows) == 2 and {r.doc_id for r in rows} == {None} and sorted(r.n_groups > 0 for r in rows) == [False, True]
    assert alignment.align(docs.limit(0), *PATHS).count() == 0


def test_segments_join_to_the_text():
    own = alignment.Aligner(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    for text in filter(None, ODD):
        assert " ".join(own.segments(text)) == text
        assert own.segments(text) == [s[1:] for s in alignment.SEGMENT.split(" " + text)]


def test_numbers_pack(spark):
    for values in ([], [0], [1, 2 ** 32 - 1, 70_000, 255, 256]):
        assert alignment.unpacked(alignment.packed(np.array(values, np.int64))).tolist() == values


@pytest.mark.parametrize("limit", [1, 40])
def test_blocks_end_and_are_put_together(monkeypatch, limit):
    """Blocks of few words hold all texts once."""
    monkeypatch.setattr(alignment, "WORDS_IN_BLOCK", limit)
    own, seen = alignment.Aligner(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read()), []
    block = alignment.Block(own)
    for k in range(30):
        block.add([k], ["one two three"])
        if block.full():
            seen += [i for r in block.rows() if r["kind"] == alignment.TEXTS for i in r["ids"]]
            block = block.following()
    assert sorted(seen + block.ids) == list(range(30))
