"""Token alignment against whole-text encodings and plain counting."""

from __future__ import annotations

import collections
import hashlib

import pytest

from framescope.llm import align

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_a string, row double, pairs int"
TEXTS = ["plain words here", "plain words, and more words here!", "", None, " leading  and   inner spaces ", "tab\tand\nline\n\nbreaks \n",
         "<|endoftext|> is plain <s> text </s>", "日本語のテキスト ünïcödé 😀", "a▁b", "it's we're 12345 x=1;y=2", "nul \x00 byte",
         "ends with space ", "x" * 300, "no break space   and 　 wide", "\x1c odd \x1d separators", "plain words here", " ", "\n", "A", "ﬁ ligature"]


def brute(rows):
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(align.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.B_FILE)
    char = {c: bytes([v]) for c, v in align._byte_values().items()}
    name = {i: t for t, i in a.get_vocab().items()}

    def b_raw(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    texts, count = [], collections.Counter()
    for doc, text in rows:
        xs, ys = [], []
        if text:
            xs, ys = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ax, bx = [b"".join(char[c] for c in name[i]) for i in xs], [b_raw(i) for i in ys]
            if not b"".join(ax) == b"".join(bx) == (" " + text).encode():
                xs, ys = [], []
        if not xs:
            texts.append((doc, [], [], [], []))
            continue
        ends_a, ends_b, at = [], [], 0
        for raw in ax:
            at += len(raw)
            ends_a.append(at)
        at = 0
        for raw in bx:
            at += len(raw)
            ends_b.append(at)
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(xs[ends_a.index(c)], ys[ends_b.index(c)]) for c in cuts]
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, e in zip(xs, ends_a) if low < e <= c) + "|"
                          + ",".join(str(y) for y, e in zip(ys, ends_b) if low < e <= c))
            low = c
        count.update(links)
        texts.append((doc, xs, ys, groups, links))
    top = {}
    for (x, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return sorted((str(doc), len(xs), len(ys), len(groups), len(links), sum(count[k] == top[k[1]] for k in links),
                   sum(count[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if xs else "")
                  for doc, xs, ys, groups, links in texts)


def answers(df):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                  for r in df.collect())


@pytest.mark.parametrize("hot", [None, 3, 0])
def test_alignment_of_odd_texts_equals_brute_force(spark, hot):
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    df = spark.createDataFrame([r + ("n", 1.0, 2) for r in rows], SCHEMA).repartition(3)
    got = answers(align.aligned(df, hot=hot))
    assert got == brute(rows)
    assert sum(r[1] == 0 for r in got) >= 3


def test_alignment_of_documents_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert answers(align.aligned(df, hot=200)) == brute(rows)


def test_links_hold_every_pair(spark):
    df = spark.createDataFrame([(1, "plain words here"), (2, "unbelievably plain")], "doc_id long, text string")
    table, texts = align.links(df).collect(), align.aligned(df).collect()
    assert sum(r["n"] for r in table) == sum(r["n_links"] for r in texts)
    assert {r["b_id"] for r in table if r["best"]} == {r["b_id"] for r in table}


def test_alignment_of_an_empty_table(spark):
    assert align.aligned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forgetting_chunks_changes_nothing(monkeypatch):
    both = align.Pair(align.A_FILE, align.B_FILE)
    want = [[c.to_pylist() for c in both.encode([t])] for t in TEXTS]
    monkeypatch.setattr(align, "REMEMBERED", 4)
    monkeypatch.setattr(align, "SHORT", 5)
    again = align.Pair(align.A_FILE, align.B_FILE)
    assert [[c.to_pylist() for c in again.encode([t])] for t in TEXTS] == want
    assert len(again.chunks.number) == len(again.chunks.spelled)
    again.apart = False
    assert [c.to_pylist() for c in again.encode(TEXTS)] == [[x for part in parts for x in part] for parts in zip(*want)]
