"""Chat formatting, lexical search and token alignment against brute force, with odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from brokerlake.llm import alignment, chat, lexical
from brokerlake.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op12_lexical_search"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("conversations", "documents", "benchmark"):
        duck.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    assert [d[0] for d in result.description] == found.columns
    rows = result.fetchall()
    assert rows and sorted(map(tuple, found.collect())) == sorted(rows)


# chat

TURNS = "conv_id long, turn long, role string, text string, piece string, _number int"


def turns(spark, rows):
    return spark.createDataFrame([(*row, "x", 7) for row in rows], TURNS)


ODD_TURNS = [
    (1, 1, "assistant", "  two\n"), (1, 0, "user", "one <|im_end|> <\\|x \\<\\\\| é😀"),
    (2, 0, "user", None), (2, 0, "user", None), (2, None, "assistant", ""), (3, 5, None, "no role"),
    (3, 6, "a b\n<|im_start|>", "odd role"), (None, 0, "user", "u"), (None, 1, "assistant", "<" * 50_000 + "|"),
    (4, 0, "assistant", "early"), (5, 0, "system", "s"), (6, 1, "user", "later"), (6, 0, "system", "s"),
]


def test_chat_round_trip(spark):
    formatted = chat.format_conversations(turns(spark, ODD_TURNS))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in ODD_TURNS:
        groups[conv].append(((turn is None, turn or 0), role or "", text or ""))
    assert set(got) == set(groups)
    whole = {r.conv_id: r for r in formatted.collect()}
    for conv, rows in groups.items():
        rows.sort()
        said = [text for _, role, text in rows if role == "assistant"]
        assert got[conv].n_turns == len(rows)
        assert got[conv].turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in rows))
        assert got[conv].loss_chars == sum(map(len, said)) and got[conv].loss_sha256 == sha("".join(said))
        assert got[conv].formatted_chars == len(whole[conv].formatted)
        assert whole[conv].formatted.count("<|im_start|>") == len(rows)
        cut = [whole[conv].formatted[s.start:s.end] for turn in whole[conv].loss for s in turn]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", c) for c in cut] == said
    verdicts = {conv: (r.valid, r.refused_at) for conv, r in whole.items()}
    assert verdicts == {
        1: (True, None), 2: (False, 2), 3: (False, 1), None: (True, None), 4: (False, 1), 5: (False, None),
        6: (True, None),
    }


def test_chat_template_is_declared(spark):
    template = chat.Template(
        open="<|turn|>", close="<|stop|>", trained={"bot": frozenset({"text", "close"})},
        follows={("begin", "man"): "asked", ("asked", "bot"): "begin"}, accepting=frozenset({"begin"}),
    )
    rows = [(1, 0, "man", "hi <|turn|>"), (1, 1, "bot", "yes"), (2, 0, "man", "hi")]
    found = {r.conv_id: r for r in chat.format_conversations(turns(spark, rows), template).collect()}
    assert found[1].formatted == "<|turn|>man\nhi <\\|turn|><|stop|><|turn|>bot\nyes<|stop|>"
    assert [found[1].formatted[s.start:s.end] for s in found[1].loss[1]] == ["yes", "<|stop|>"]
    assert found[1].valid and not found[2].valid
    with pytest.raises(ValueError):
        chat.Template(open="[user]")


def test_chat_is_native_and_shuffles_once(spark):
    found = chat.digests(chat.format_conversations(turns(spark, ODD_TURNS)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
    assert chat.digests(chat.format_conversations(turns(spark, []))).count() == 0


# search

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def brute_search(docs, items, k=20):
    def words(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    split = [(doc, Counter(words(text))) for doc, text in docs]
    split = [(doc, found) for doc, found in split if found]
    n, total = len(split), sum(sum(found.values()) for _, found in split)
    df = Counter(word for _, found in split for word in found)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(words(text))
    rows = []
    for item, wanted in asked.items():
        scores = []
        for doc, found in split:
            m = 75 + 25 * sum(found.values()) * n // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[word] + 1)))
                * (1_000_000_000 * found[word] // (1000 * found[word] + 12 * m))
                for word, times in wanted.items() if word in found
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return rows


def some_docs(seed, count):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS, rng.integers(1, 40), p=np.arange(1, 11) / 55))) for i in range(count)]


ODD_DOCS = [
    (900, None), (901, ""), (902, " .,-\x7f"), (903, "ÀB alpha_beta 10.5 Éa"), (903, "alpha"), (903, "alpha"),
    (None, "alpha alpha"), (None, "ZETA"), (904, "beta " * 30_000), (905, "İ ſ K alpha"),
]
ITEMS = [
    (1, "alpha Beta, beta"), (2, "iota kappa zeta"), (3, None), (4, ""), (5, "nowhere"), (6, "àb ÉA 10"),
    (7, "alpha"), (7, "beta"), (None, "theta eta"),
]


def ranked(rows):
    return sorted(map(tuple, rows), key=repr)


def test_search_brute_force(spark):
    docs = some_docs(1, 300) + ODD_DOCS
    table = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, n int, score string")
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, rank int")
    want = ranked(brute_search(docs, ITEMS))
    assert ranked(lexical.search(table.repartition(3), items).collect()) == want
    assert lexical.search(table.limit(0), items).count() == 0
    assert lexical.search(table, items.limit(0)).count() == 0
    assert lexical.search(table.where("text is null"), items).count() == 0


def test_search_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    docs = some_docs(2, 60)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [len(b) for b in lexical.blocks(items)] == [2, 2, 2]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert ranked(lexical.search(table, items, 3).collect()) == ranked(brute_search(docs, ITEMS, 3))


def test_search_shards_of_a_task(monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    docs = some_docs(3, 5 * 64 + 11)
    wanted = {word.encode(): i for i, word in enumerate(WORDS)}
    counts = [Counter(wanted[w] for w in lexical.terms(text)) for _, text in docs]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([doc for doc, _ in docs], pa.int64()),
        "n": pa.array([sum(c.values()) for c in counts], pa.int64()),
        "terms": pa.array([list(c) for c in counts], pa.list_(pa.int32())),
        "counts": pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())),
    })
    df = Counter(t for c in counts for t in c)
    total = sum(sum(c.values()) for c in counts)
    ids = np.array([0, 4, 9])
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in ids])
    task = lexical._search_task([(ids, weights)], len(WORDS), len(docs), total, 20)
    got = [r for b in task([batch.slice(0, 100), batch.slice(100)]) for r in b.to_pylist()]
    want = brute_search(docs, [(0, f"{WORDS[0]} {WORDS[4]} {WORDS[9]}")])
    assert [(r["doc_id"], r["score"]) for r in got] == [(doc, score) for _, _, doc, score in want]


def test_search_stops_above_the_last_position():
    # short documents with all terms first, then long ones with one term each
    n = np.concatenate([np.full(30, 4), np.full(3000, 400)])
    terms = np.concatenate([np.tile(np.arange(4), 30), np.arange(3000) % 4])
    rows = np.concatenate([np.repeat(np.arange(30), 4), np.arange(30, 3030)])
    shard = lexical.Shard(n, terms, np.ones(len(terms), "i4"), rows, 4, len(n), int(n.sum()))
    found, scores, depth = shard.search(np.arange(4), np.full(4, 1000), 20, np.zeros(0, "i8"))
    assert set(found[np.argsort(-scores, kind="stable")][:20]) <= set(range(30))
    assert depth < 100 < np.diff(shard.starts).min()  # stops long before the lists end
    # thirty equal scores, twenty asked for: no document of that score may be missed
    assert (scores == scores.max()).sum() == 30


# alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [
    None, "", " ", "a", "two  spaces", "tail ", " head", "line\nbreak\n", "\n\n x", "tab\tx y", "😀 naïve ﬁ",
    "under▁bar", "<|endoftext|> </s><s>", "İstanbul 中文字 ألف", "don't 123456 !!!", "\x00\x01 nul",
    "a\n b", "x" * 3000, "word " * 20_000, "a", "zwj 👩‍👩‍👧 é", "<0x41> <unk>",
]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    both = alignment.sides(A, B)
    rows, links, corpus = [], [], Counter()
    for text in texts:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        said = (" " + text).encode() if text else b""
        if not text or any(b"".join(told[i] for i in ids) != said for ids, told in ((a, both.a_bytes), (b, both.b_bytes))):
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        a_ends = {e: i for i, e in enumerate(np.cumsum([len(both.a_bytes[i]) for i in a]).tolist())}
        b_ends = {e: i for i, e in enumerate(np.cumsum([len(both.b_bytes[i]) for i in b]).tolist())}
        shown, own, i, j = [], [], 0, 0
        for end in sorted(a_ends.keys() & b_ends.keys()):
            to_i, to_j = a_ends[end] + 1, b_ends[end] + 1
            shown.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
            own.append((a[to_i - 1], b[to_j - 1]))
            i, j = to_i, to_j
        rows.append((len(a), len(b), len(shown), len(own), sha(";".join(shown))))
        links.append(own)
        corpus.update(own)
    highest = defaultdict(int)
    for (_, b), n in corpus.items():
        highest[b] = max(highest[b], n)
    return [
        (*row, sum(corpus[x] == highest[x[1]] for x in own), sum(corpus[x] for x in own))
        for row, own in zip(rows, links)
    ], corpus


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_alignment_brute_force(spark):
    given = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    said = ODD_TEXTS + given
    rows = [(i, text, 1, "x") for i, text in enumerate(said)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs string").repartition(5)
    found = alignment.align_corpus(docs, A, B)
    got = {r.doc_id: tuple(r[c] for c in FIGURES) for r in found.collect()}
    want, corpus = plain_alignment(said)
    assert got == dict(enumerate(want))
    assert sum(w[0] > 0 for w in want[:len(ODD_TEXTS)]) > 10
    assert len(corpus) <= alignment.pair_bound(A, B) < 1_000_000


def test_alignment_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (2, None)], "doc_id long, text string")
    got = alignment.align_corpus(docs, A, B).collect()
    assert len(got) == 4 and got[0][1:] == got[1][1:] and got[2].doc_id is None
    assert tuple(got[3])[1:] == (0, 0, 0, 0, "", 0, 0)
    assert alignment.align_corpus(docs.limit(0), A, B).count() == 0


def test_words_are_aligned_once(monkeypatch):
    """Repeated words are matched once; a forgotten word, and one that no other is joined with, like the rest."""
    import pandas as pd

    matched, plain = [], pd.merge_asof
    monkeypatch.setattr(pd, "merge_asof", lambda left, *a, **k: matched.append(len(left)) or plain(left, *a, **k))
    both = alignment.Sides(A, B)
    said = ["Straßenbahn, naïveté... and\nmore" + " and more" * 5_000, "x  y under", "under▁bar and", "", "tail "]
    want = plain_alignment(said)[0]
    for _ in range(2):
        n_a, n_b, links, groups, _ = both.align(said)
        assert [(a, b, n, n, sha(g.decode()) if g else "") for a, b, n, g in zip(n_a, n_b, links, groups)][:3] == [
            row[:5] for row in want[:3]]
    assert sum(matched) < 200
    monkeypatch.setattr(alignment, "_KEEP", 0)
    assert both.align(said)[3] == groups and len(both.known) < 20


def test_overlaps_are_all_that_share_bytes(spark):
    said = ["Straßenbahnhaltestelle naïveté, antidisestablishmentarianism", "a  b", "x", None]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {tuple(r) for r in alignment.overlaps(docs, A, B).collect()}
    both = alignment.sides(A, B)
    want = set()
    for doc, text in enumerate(said):
        if not text:
            continue
        [(a, b)] = both.encode([text])
        a_end, b_end = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lo = max(a_end[i] - both.a_sizes[x], b_end[j] - both.b_sizes[y])
                hi = min(a_end[i], b_end[j])
                if lo < hi:
                    want.add((doc, i, j, int(x), int(y), int(lo), int(hi), bool(a_end[i] == b_end[j])))
    assert got == want
