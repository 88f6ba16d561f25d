"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A page is a row of tokens: its tags, each with the path of elements around it, and its text blocks,
each with its path. A token's occurrence vector says how often each page of the host holds it.
Vectors are never formed: a page adds two hashes of (page, count) to sums that Spark combines, and
tokens with equal sums, pages and occurrences form a class. Classes on enough pages are the host's
template. Equal pages of a host count once: copies say nothing of what varies. In a page, the class of tokens found once everywhere cuts it into slots, in template
order; another class is nested in the slot that holds all of its tokens, and one that crosses slots
is invalid there. Texts that belong to a valid class together with the very element around them
are the template's own words; what remains in the slots is the page's data.

Of the data, blocks in elements that name themselves as no main text go (``html_pages``), and where
a page marks its main part, so does all outside of it. Without a mark, slots of mostly link text
go, and texts that stand on nearly all pages.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored, texts
from brokerlake.llm.html_pages import Block, Page

#: Pages that a class must be found on: so many, and this share of the host's.
LEAST_PAGES, LEAST_SHARE = 5, 0.05
#: The share of pages on which a text outside of a marked main part is the template's.
COMMON_SHARE = 0.8
#: The share of link text from which an unmarked slot is navigation.
LINKS = 0.6
#: Tokens of a task that are summed up before they are handed on.
HELD_TOKENS = 200_000

_SUMS = "host string, token long, pages long, occurrences long, one long, two long, place double"
_M31 = (1 << 31) - 1

#: A host's template: token -> (class, tokens in the class are on all pages, place, share of pages).
Template = dict[int, tuple[int, bool, float, float]]


def host_of(url: Column) -> Column:
    """The host in lower case without port; what has none is one host of its own."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    return F.lower(F.regexp_replace(found, r"^.*@|:[0-9]*$", ""))


def _hash64(data: bytes, seed: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data, seed)


def text_token(block: Block) -> int:
    """A signed 64-bit token for a text at its place among the elements."""
    found = _hash64(block.text.encode("utf-8", "replace"), block.element.path) | 1 << 62
    return found - (1 << 64) if found >> 63 else found


def _page_sums(name: int, html: str) -> Iterator[tuple[int, tuple]]:
    page = Page(html)
    tags = Counter(page.tags)
    first = {}
    for at, tag in enumerate(page.tags):
        first.setdefault(tag, at)
    length = max(1, len(page.tags))
    for token, count in [*tags.items(), *Counter(map(text_token, page.blocks)).items()]:
        vote = _hash64(b"%d:%d" % (name, count), 0)
        yield token, (1, count, vote & _M31, vote >> 33, first.get(token, 0) / length)


def token_sums(pages: DataFrame) -> DataFrame:
    """(host, token, pages, occurrences, one, two, place) of ``pages`` (host, page, html)."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple[str, int], list] = {}

        def rows():
            columns = list(zip(*((*key, *value) for key, value in held.items())))
            kinds = (pa.string(), *[pa.int64()] * 5, pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["host", "token", "pages", "occurrences", "one", "two", "place"],
            )

        for batch in batches:
            hosts, names = (batch.column(c).to_pylist() for c in ("host", "page"))
            for host, name, html in zip(hosts, names, texts(batch.column("html"))):
                for token, add in _page_sums(name, html):
                    key = host, token
                    known = held.get(key)
                    held[key] = add if known is None else tuple(map(sum, zip(known, add)))
                if len(held) > HELD_TOKENS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    sums = ("pages", "occurrences", "one", "two", "place")
    return pages.mapInArrow(measure, _SUMS).groupBy("host", "token").agg(
        *(F.sum(c).alias(c) for c in sums)
    )


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, page, html): each html of a host once, ``page`` being its hash; NULLs go.

    Only html that has copies is shuffled, and that after a reduction in each task.
    """
    rows = pages.where("html is not null").select("host", F.xxhash64("html").alias("page"), "html")
    copied = stored(
        rows.groupBy("host", "page").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "copies"
    )
    once = rows.join(copied, ["host", "page"], "left_anti")
    return once.unionByName(
        rows.join(copied, ["host", "page"], "left_semi").dropDuplicates(["host", "page"])
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens): the template of each host, an array of (token, kind, whole, place, share).

    ``pages`` (host, html) may hold copies. A host's array is bounded by the tokens of a page over
    ``LEAST_SHARE``, not by its pages.
    """
    sizes = pages.where("html is not null").groupBy(F.col("host").alias("_host")).agg(
        F.countDistinct(F.xxhash64("html")).alias("_all")
    )
    often = (
        token_sums(distinct_pages(pages)).where(F.col("pages") >= LEAST_PAGES)
        .join(sizes, F.col("host") == F.col("_host"))
        .where(F.col("pages") >= LEAST_SHARE * F.col("_all"))
    )
    member = F.struct(
        "token", F.xxhash64("pages", "occurrences", "one", "two").alias("kind"),
        ((F.col("pages") == F.col("_all")) & (F.col("occurrences") == F.col("_all"))).alias("whole"),
        (F.col("place") / F.col("pages")).alias("place"),
        (F.col("pages") / F.col("_all")).alias("share"),
    )
    return often.groupBy("host").agg(F.collect_list(member).alias("tokens"))


def slots(page: Page, template: Template) -> tuple[list[int], dict[int, int]]:
    """The slot of each tag of a page, and the slot of each valid class other than the root.

    A slot begins at a token of the root class that stands in template order.
    """
    places, now, reached = [], 0, -1.0
    homes: dict[int, set[int]] = defaultdict(set)
    for tag in page.tags:
        known = template.get(tag)
        if known and known[1] and known[2] >= reached:
            reached = known[2]
            now += 1
        places.append(now)
        if known and not known[1]:
            homes[known[0]].add(now)
    return places, {kind: min(found) for kind, found in homes.items() if len(found) == 1}


def main_blocks(page: Page, template: Template) -> list[str]:
    """The texts of a page that are neither template nor beside its main part."""
    places, nested = slots(page, template)
    roots = {known[0] for known in template.values() if known[1]}
    kept: list[tuple[int, Block]] = []
    marked = any(b.element.on and not b.element.off for b in page.blocks)
    for block in page.blocks:
        if block.element.off or marked and not block.element.on:
            continue
        known = template.get(text_token(block))
        if known:
            around = template.get(block.element.path << 1)
            valid = known[0] in nested or known[0] in roots
            if valid and around and around[0] == known[0]:
                continue
            if not marked and known[3] >= COMMON_SHARE:
                continue
        kept.append((places[block.tag] if block.tag < len(places) else 0, block))
    if not marked:
        size, linked = Counter(), Counter()
        for slot, block in kept:
            size[slot] += len(block.text)
            linked[slot] += min(len(block.text), block.linked)
        kept = [(s, b) for s, b in kept if linked[s] < LINKS * size[s]]
    return [block.text for _, block in kept]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A NULL or empty html has the empty text; a NULL url belongs to the host without name. Repeated
    rows are pages of their own, though one for the template, and NULL page_ids are kept; an empty table gives an empty result.
    Other columns are ignored.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    known = stored(templates(rows.select("host", "html")), "templates")
    # one row a host: broadcast where Spark finds the table small, else a join that it can split
    joined = rows.join(known.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ready: dict[str, Template] = {}
        for batch in batches:
            found = []
            hosts, tokens = batch.column("host").to_pylist(), batch.column("tokens")
            for at, html in enumerate(texts(batch.column("html"))):
                host = hosts[at]
                if host not in ready:
                    if len(ready) > 200:
                        ready.clear()
                    ready[host] = {
                        t["token"]: (t["kind"], t["whole"], t["place"], t["share"])
                        for t in tokens[at].as_py() or ()
                    }
                found.append("\n".join(main_blocks(Page(html), ready[host])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                 pa.array(list(map(len, found)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "host", "html", "tokens").mapInArrow(
        read, f"page_id {kind}, url string, text string, n_chars long"
    )
