"""The corpus operators against brute force, round trips and held-out labels, with odd rows."""

import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brokerlake.llm import (
    embeddings, fingerprints, html_extraction, html_pages, mixing, packing, pii, quality, simhash,
    token_files, warc,
)

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _row int"
WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho "
         "sigma tau upsilon phi chi psi omega").split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


ODD = [
    (1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, prose(2, 30_000)), (6, prose(3, 9)),
    (6, prose(3, 9)), (None, prose(4, 50)), (None, None), (7, " \t\n"), (8, "a@b.co +1 (555) 010-9999 10.0.0.1"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, ("a", "b", None)[k % 3], len(t or ""), "x", k) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_quality_held_out(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.predicted == r.quality for r in held]) >= 0.8


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(empty, labels.limit(0)).count() == 0


ARTICLE = "<nav><a href=x>menu</a></nav><article><h1>{0}</h1><p>{1} &amp; co</p>\n<p>two\n {0}<br>x</p></article>"
LOOSE = "<div id=m1><a href=x>home</a></div><div class=t><b>Our shop</b></div><div class=c><p>{0}</p><p>{1}</p></div>"


def test_html_marked_and_deduced(spark):
    pages = [(k, "http://a.org/1", ARTICLE.format(k, prose(k, 20)), "x") for k in range(8)]
    pages += [(100 + k, "http://b.org/1", LOOSE.format(prose(k, 20), prose(50 + k, 30)), "x") for k in range(8)]
    pages += [(200, None, None, "x"), (201, "", "", "x"), (None, "u", "plain <b>text", "x"),
              (202, "http://c.org", "<p>" * 50_000, "x"), (0, "http://a.org/1", pages[0][2], "x")]
    got = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string, host string"))
    rows = got.collect()
    found = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    for k in range(8):
        assert found[k] == f"{k}\n{prose(k, 20)} & co\ntwo {k}\nx"
        # without marks the repeated words and the link slot go, the varying slots stay
        assert found[100 + k] == f"{prose(k, 20)}\n{prose(50 + k, 30)}"
    assert found[200] == found[201] == found[202] == "" and found[None] == "plain text"


def test_html_copies_are_one_page_for_the_template(spark):
    one = "<nav><a href=x>menu</a></nav><article><h1>Title</h1><p>{0}</p></article>".format(prose(1, 20))
    loose = "<div><h2>Head</h2><p>{0}</p></div>".format(prose(2, 20))
    quote = ARTICLE.format("q", prose(3, 20)).replace("<br>x", "</p><blockquote>said once</blockquote><p>x")
    pages = [(k, "http://a.org/", one) for k in range(8)] + [(10 + k, "http://b.org/", loose) for k in range(8)]
    pages += [(20 + k, "http://c.org/", quote) for k in range(8)]
    pages += [(30 + k, "http://c.org/", ARTICLE.format(k, prose(k, 20))) for k in range(20)]
    rows = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = {r.page_id: r.text for r in rows}
    assert len(found) == len(rows) == len(pages)
    for k in range(8):
        assert found[k] == f"Title\n{prose(1, 20)}"
        assert found[10 + k] == f"Head\n{prose(2, 20)}"
        assert found[20 + k] == f"q\n{prose(3, 20)} & co\ntwo q\nsaid once\nx"
    assert found[30] == f"0\n{prose(0, 20)} & co\ntwo 0\nx"


@pytest.mark.parametrize("html", [
    "<div id=content class='with-sidebar'>{0}</div>", "<main class='no-sidebar'>{1}</main>",
    "<article class='post comments-open'>{1}</article>", "<div class='share-enabled'>{1}</div>",
    "<div class='page sidebar'>{0}</div>", "<form><main>{1}</main></form>", "<article class='widget'>{1}</article>",
    "<main><div class='row sidebar'><h1>Head</h1><article><p>Body</p></article></div></main>",
    "<div class='page sidebar'>{0}</div><div class=sidebar>off</div>", "<div data-id=share>{1}</div>",
    "{0}<section class='comments'><article class='comment'><p>off</p></article></section>",
    "<main>{0}<aside><article>off</article></aside></main>", "<article>{1}<div class='related'>off</div></article>",
])
def test_html_names_are_whole_words_and_spare_articles(html):
    article = "<article><h1>Head</h1><p>Body</p></article>"
    page = html_extraction.Page(html.format(article, "<h1>Head</h1><p>Body</p>"))
    assert html_extraction.main_blocks(page, {}) == ["Head", "Body"]


def test_html_given_pages(spark):
    pages = read(spark, "pages")
    rows = html_extraction.extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    for r in rows:
        inside = re.search(r"<h1>(.*?)</h1>", r.html, re.S)
        assert r.text and (not inside or len(r.text) >= 3)
    assert html_extraction.extract(pages.limit(0)).count() == 0


def components(n, linked):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_embeddings_brute_force(spark):
    rows = read(spark, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = components(len(rows), lambda i, j: near[i, j])
    got = {r.vec_id: r for r in embeddings.near_duplicates(read(spark, "embeddings")).collect()}
    for i, r in enumerate(rows):
        assert got[r.vec_id].component_id == rows[want[i]].vec_id
        assert got[r.vec_id].n_links == near[i].sum() - 1


def at_cosine(rng, unit, cosine):
    """A unit vector at the given cosine to ``unit``."""
    other = rng.normal(size=len(unit))
    other -= other @ unit * unit
    return cosine * unit + (1 - cosine**2) ** 0.5 * other / np.linalg.norm(other)


@pytest.mark.parametrize("dimensions", [16, 96])
def test_embeddings_find_planted_pairs(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    seeds = embeddings.units(rng.normal(size=(400, dimensions)))
    planted = rng.uniform(0.901, 0.95, 400)
    partners = [at_cosine(rng, u, c) for u, c in zip(seeds, planted)]
    beside = [at_cosine(rng, u, 0.899) for u in seeds[:100]]  # just below: no link
    unit = np.array([*seeds, *partners, *beside])
    near = unit @ unit.T >= 0.9
    scale = rng.uniform(0.1, 10, len(unit))
    vectors = spark.createDataFrame(
        [(k, (v * f).tolist()) for k, (v, f) in enumerate(zip(unit, scale))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(vectors).collect()}
    want = components(len(unit), lambda i, j: near[i, j])
    alone = near.sum(1) == 1
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in np.flatnonzero(alone))
    assert all(want[got[k].component_id] == want[k] for k in got)  # no link below 0.9
    assert np.mean([got[k].component_id == want[k] for k in np.flatnonzero(~alone)]) >= 0.95


def test_embeddings_of_a_group_beyond_one_block(spark, monkeypatch):
    rng = np.random.default_rng(1)
    seed = embeddings.units(rng.normal(size=(1, 32)))[0]
    unit = np.array([at_cosine(rng, seed, c) for c in rng.uniform(0.97, 0.999, 400)])
    unit = np.concatenate([unit, embeddings.units(rng.normal(size=(100, 32)))])
    near = unit @ unit.T >= 0.9
    want = components(len(unit), lambda i, j: near[i, j])
    vectors = spark.createDataFrame(
        [(k, v.tolist()) for k, v in enumerate(unit)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    got = {r.vec_id: r for r in embeddings.near_duplicates(vectors).collect()}
    assert [got[k].component_id for k in range(len(unit))] == want
    assert [got[k].n_links for k in range(len(unit))] == (near.sum(1) - 1).tolist()


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.1]), (8, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors).collect())
    assert got == [(0, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5),
                   (6, 0, 6), (7, 0, 7), (8, 0, 8)]
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(?:\.[0-9]+){3}"), ("card", r"[0-9](?:[ -]?[0-9])+"),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]")]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def base(text):
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15}[kind]:
                yield m.start(), rank, f"{kind}:{m.start()}:{m.end()}"


def test_pii_base_spans(spark, odd, empty):
    docs = read(spark, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    model = pii.fit(docs)
    got = sorted((r.doc_id or -1, r.base_sha256, r.spans) for r in pii.detect(docs, model).collect())
    want = []
    for r in docs.collect():
        spans = [s for *_, s in sorted(base(r.text or ""))]
        want.append((r.doc_id or -1, hashlib.sha256(",".join(spans).encode()).hexdigest(), spans))
    want.sort()
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert pii.detect(empty, pii.fit(empty)).count() == 0


def test_pii_finds_loose_forms_where_there_are_many(spark):
    rng = np.random.default_rng(7)

    def number(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def card():
        digits = number(15)
        return next(digits + c for c in "0123456789" if luhn(digits + c))

    docs, planted, dull = [], {}, {}
    for k in range(400):
        local, c = f"{rng.integers(2, 10)}{number(9)}", card()
        while luhn(f"2024{local}") or luhn(f"1234{local}"):  # else a card in the fixed format
            local = f"{rng.integers(2, 10)}{number(9)}"
        a, b, d = local[:3], local[3:6], local[6:]
        text, fixed = f"mail joe{k}@site.com or +1 {a}{b}{d} now {prose(k, 6)}", card()
        loose = [("phone", f"{a}-{b}-{d}"), ("phone", f"({a}) {b}-{d}"), ("card", " - ".join(c[i : i + 4] for i in (0, 4, 8, 12))),
                 ("card", ".".join(c[i : i + 4] for i in (0, 4, 8, 12))), ("email", f"joe{k} at site dot org"),
                 ("ip", f"10[.]{k % 256}[.]3[.]4")]
        text += f" card {fixed} host 10.0.0.{k % 256} "
        for kind, body in loose:
            text += f"{prose(900 + k, 3)} "
            planted.setdefault(k, []).append(f"{kind}:{len(text)}:{len(text) + len(body)}")
            text += f"{body} "
        for stray in ("2024 ", "12 34 "):
            text += f"{prose(500 + k, 3)} {stray}"
            planted[k].append(f"phone:{len(text)}:{len(text) + 12}")
            text += f"{a}-{b}-{d} "
        dull[k] = len(text)
        docs.append((k, text + f"{prose(k, 4)} 2024-10-12 11.30 {prose(k, 3)} 1990-1995 2001 {prose(k, 3)} sold at cost.The end"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = pii.detect(table, pii.fit(table)).collect()
    found = {r.doc_id: set(r.spans.split(",")) for r in rows}
    for place in range(8):
        assert np.mean([planted[k][place] in found[k] for k in found]) >= 0.9, place
    assert sum(int(s.split(":")[1]) >= dull[k] for k in found for s in found[k]) <= 0.02 * len(found)


def simple_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_brute_force(spark, odd, empty):
    docs = read(spark, "documents").select("doc_id", "text").where("length(text) < 20000").union(
        odd.where("doc_id is not null").select(F.col("doc_id") + 10**6, F.substring("text", 1, 5000)))
    rows = docs.orderBy("doc_id").collect()
    prints = [simple_fingerprint(r.text or "") for r in rows]
    want = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (prints[i], rows[want[i]].doc_id) for i, r in enumerate(rows)}
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(empty).count() == 0


def test_bk_tree_follows_only_the_radius():
    rng = np.random.default_rng(5)
    codes = [int(c) for c in rng.integers(0, 1 << 20, 400)]
    tree = simhash.BKTree()
    for code in codes:
        tree.add(code)
    for code in codes[:40]:
        hits = sorted(tree.within(code, 4))
        assert hits == [i for i, c in enumerate(codes) if (c ^ code).bit_count() <= 4]


def near_codes(seed, count, groups):
    """Random 64-bit codes, and chains of codes that differ by one to four bits from the one before."""
    rng = np.random.default_rng(seed)
    codes = {int(c) for c in rng.integers(0, 1 << 64, count, np.uint64)}
    for code in list(codes)[:groups]:
        for _ in range(3):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                code ^= 1 << int(bit)
            codes.add(code)
    return sorted(codes)


@pytest.mark.parametrize("count", [0, 1, 512, 513, 10**4, 10**6, 10**8, 10**10, 10**14])
@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_codes_within_the_radius_share_a_mask(count, radius):
    masks = simhash.shard_masks(count, radius)
    rng = np.random.default_rng(count % 1000)
    for _ in range(300):
        change = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(mask & change == 0 for mask in masks)
    if count <= 10**10 and radius == 4:
        assert {mask.bit_count() for mask in masks} == {max(0, (-(-count // simhash.TREE) - 1).bit_length())}


def test_trees_hold_hundreds_of_codes_and_skip_most_of_the_rest():
    class Counted(list):
        seen = 0

        def __getitem__(self, at):
            Counted.seen += 1
            return super().__getitem__(at)

    codes = near_codes(3, 20_000, 2_000)
    masks = simhash.shard_masks(len(codes), 4)
    assert len(masks) == 5
    compared, links, sizes = 0, set(), []
    for mask in masks:
        shards = {}
        for code in codes:
            shards.setdefault(code & mask, []).append(code)
        for shard in shards.values():
            tree = simhash.BKTree()
            for code in shard:
                tree.add(code)
            tree.codes = Counted(tree.codes)
            sizes.append(len(shard))
            for code in shard[::20]:
                links.update((code, shard[hit]) for hit in tree.within(code, 4) if shard[hit] != code)
                compared += len(shard)
    assert min(sizes) > 200 and Counted.seen < 0.5 * compared
    assert len(links) > 200 and all((a ^ b).bit_count() <= 4 for a, b in links)


def test_simhash_links_of_many_codes(spark, monkeypatch):
    codes = near_codes(7, 3_000, 400)
    codes += [code for code in near_codes(8, 300, 300) if code not in codes]
    want = components(len(codes), lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 4)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    for chunk in (simhash.CHUNK, 256):  # the second cuts every shard into chunks
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        place = {c: k for k, c in enumerate(signed)}
        parent = list(range(len(codes)))

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in simhash.near_links(frame).collect():
            assert (a ^ b) % 2**64 and ((a ^ b) % 2**64).bit_count() <= 4
            parent[max(root(place[a]), root(place[b]))] = min(root(place[a]), root(place[b]))
        assert [root(k) for k in range(len(codes))] == want, chunk


def test_mix_rows_and_targets(spark, odd, empty):
    docs = read(spark, "documents")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    assert all(r.taken <= 3 * r.size for r in rows)
    taken = docs.select("doc_id", "source").join(mixing.mix(docs), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in taken)
    # within a hundredth, or half of the shortest document that could still join
    sizes = {}
    for r in mixing._shares(docs, "doc_id", mixing.WEIGHTS, mixing.MAX_EPOCHS, mixing.SEED).collect():
        if r.size and r.copies == r._epochs:
            sizes.setdefault(r.source, []).append(r.size)
    for r in taken:
        assert abs(r.taken - r.target) <= max(r.target / 100, min(sizes.get(r.source, [0])) / 2), r
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0


def test_mix_repeats_whole_rows(spark, odd, empty):
    for docs in (read(spark, "documents"), odd.withColumn("_key", F.lit(1)).withColumn("size", F.lit("s"))):
        plan = {}
        for r in mixing.mix(docs).collect():
            plan[r.doc_id] = plan.get(r.doc_id, 0) + r.copies
        out = mixing.repeated(docs)
        assert out.columns == docs.columns
        got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
        assert got == {k: v for k, v in plan.items() if v}
    assert mixing.repeated(empty).count() == 0


def plain_ids(path, text, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [*tokenizer.encode(text, add_special_tokens=False).ids, end]


def test_encoder_equals_the_plain_call_on_odd_texts():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from brokerlake.llm.tokens import encoder

    rng = random.Random(3)
    parts = [*"ab AZ.,'\n\t é中😀ﬁİ\xa0\u3000\x85\x1c", "<|endoftext|>", "<|startoftext|>", " don't ", " 12", " the"]
    said = [None, "", *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000))]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder(path, spaces).encode(pa.array(said))]
        plain = Tokenizer.from_file(path)
        assert got == [plain.encode(text or "", add_special_tokens=False).ids for text in said]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = read(spark, "documents").select("doc_id", "text").limit(40)
    rows = sorted(docs.collect())
    at, want = 0, []
    for r in rows:
        ids = plain_ids(path, r.text or "", 0)
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    got = token_files.read_tokens(token_files.write_tokens(docs.repartition(3), path)).collect()
    assert sorted(map(tuple, got)) == want
    assert token_files.read_tokens(token_files.write_tokens(odd, path)).count() == len(ODD)
    assert token_files.read_tokens(token_files.write_tokens(empty, path)).count() == 0


def test_fingerprints_track_generalised_jaccard(spark, odd, empty):
    docs = read(spark, "documents").select("doc_id", "text").limit(60)
    rows = sorted(docs.collect())
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for here, after in zip(rows, [*rows[1:], rows[0]]):
        text, other = here.text or "", after.text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[here.doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = map(fingerprints.weighted_terms, (text, edited))
        keys = set(a) | set(b)
        high = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        if high:
            exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / high
            assert abs(r.near_edited - exact) < 0.25
    assert fingerprints.edited_fingerprints(odd).count() == len(ODD)
    assert fingerprints.edited_fingerprints(empty).count() == 0
    alone = fingerprints.edited_fingerprints(odd.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "u", big, "z"), (2, None, big, "z"), (3, "u", None, "z"), (4, "u", "", "z"), (5, "u", "é", "z"),
            (None, "u", big, "z"), (2, None, big, "z"), (None, None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next((p[2] or "") for p in rows if p[0] == r.page_id).encode() if r.page_id else None
        if payload is not None:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        if r.page_id == 1:
            assert (r.record_type, r.refers_to) == ("revisit", 2)
        if r.page_id in (2, 3, 4, 5):
            assert (r.record_type, r.refers_to) == ("response", None)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_packing(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = read(spark, "documents").select("doc_id", "text").limit(60).union(odd.select("doc_id", "text").where("doc_id = 5"))
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(plain_ids(path, r.text or "", 1))
    rows = packing.pack(packing.tokenized_pieces(docs, path)).collect()
    bins = {}
    for r in rows:
        assert any(r.start + r.length <= len(x) and crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id])
        assert r.start == r.piece * 4096
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert sum(r.length for r in rows) == total and len(bins) <= -(-total // 4096) + 1
    assert packing.pack(packing.tokenized_pieces(odd, path)).count() >= len(ODD)
    assert packing.pack(packing.tokenized_pieces(empty, path)).count() == 0


def test_pipeline_stages(spark):
    docs = read(spark, "documents").cache()
    _, keep = corpus_pipeline.STAGES[0]
    scores = quality.score_documents(docs, read(spark, "labels"))
    good = {r.doc_id for r in scores.where("predicted = 1").collect()}
    kept = keep(spark, docs, DATA)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    found = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").collect()
    one = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in found)
    clean = corpus_pipeline.redact_personal_data(spark, docs, DATA)
    model = pii.fit(docs)
    want = {r.doc_id: pii.redact(r.text, model) for r in docs.collect() if r.text is not None}
    for r in clean.collect():
        assert r.text == want.get(r.doc_id) and (r.text is None or r.n_chars == len(r.text))
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_pipeline_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, DATA).columns == odd.columns
        stage(spark, odd, DATA).collect()
        assert stage(spark, empty, DATA).count() == 0
    one = corpus_pipeline.drop_near_copies(spark, odd, DATA).collect()
    ids = [r.doc_id for r in one if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 2 not in ids


def test_pipeline_keeps_unlike_texts_of_one_id_and_joins_rows_without_one(spark):
    long = prose(7, 400)
    rows = [(1, prose(8, 50)), (1, prose(9, 50)), (None, long), (None, long + " omega"), (5, long), (None, prose(10, 60)),
            (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, None, "a", len(t or ""), "x", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    assert (simple_fingerprint(long) ^ simple_fingerprint(long + " omega")).bit_count() <= 4
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[1], rows[4], rows[5], rows[6]], key=repr)


def _page_text(html):
    return "\n".join(block.text for block in html_pages.Page(html).blocks)


@pytest.mark.parametrize("length", [10, 4_000, 6_000, 300_000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_quoted_attributes_of_any_length(length, quote):
    html = f"<p title={quote}{'x' * length}> LEAKED words{quote}>real</p><p>next</p>"
    assert _page_text(html) == "real\nnext"


def test_quotes_without_an_end_cost_no_text_and_no_time():
    broken = '<p class="x>one</p><p class="y">two</p><p id=\'z > z\'>three</p>'
    assert _page_text(broken) == "one\ntwo\nthree"
    # every tag's quotes would otherwise be read to the end of the page
    started = time.monotonic()
    html_pages.Page("<p a='\"><b a=\"'>" * 40_000 + "<i \">")
    html_pages.Page("<p \"<p a>\"" * 80_000 + "\"<p>")
    assert time.monotonic() - started < 20
