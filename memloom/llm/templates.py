"""Article text by template deduction: tokens that occur alike on the pages of a host form classes, valid classes the template."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.markup import Block, blocks_of
from memloom.llm.shared import stored

#: Pages of a host on which a class must occur to be valid, and the share of the host's pages.
LEAST_PAGES = 5
LEAST_SHARE = 0.5
#: Share of the text outside menus and the like that the region of the article holds at least.
REGION_SHARE = 0.7
#: A template that would take more than this share of the articles is no template: the pages are copies of each other.
MOST_CONSTANT = 0.4

TOKENS = "host string, page long, token long, kind int, path string, times int, chars long, first_root boolean"
TAG, TEXT = 0, 1


def host_of(url_column: str):
    """The host of a URL in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(F.col(url_column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tokens_of(blocks: list[Block]) -> dict[int, list]:
    """Per token its kind, path, times on the page and characters outside links: every path with its ancestors, counted by
    element, and every text in its path."""
    found: dict[int, list] = {}
    seen: set[tuple[str, int]] = set()
    for block in blocks:
        if block.noise:
            continue
        entry = found.setdefault(number("t", block.path, block.text), [TEXT, block.path, 0, 0])
        entry[2] += 1
        entry[3] += len(block.text) - block.link
        steps = block.path.split("/")
        for depth in range(1, len(steps) + 1):
            path = "/".join(steps[:depth])
            entry = found.setdefault(number("p", path), [TAG, path, 0, 0])
            element = block.elements[depth - 1] if block.elements else 0
            entry[2] += (path, element) not in seen
            seen.add((path, element))
            entry[3] += len(block.text) - block.link
    return found


def page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = TaskContext.get().partitionId() << 33
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            rows = []
            for host, html in zip(part["host"].to_pylist(), part["html"].to_pylist()):
                found = tokens_of(blocks_of(html))
                root = next((token for token, entry in found.items() if entry[0] == TAG and "/" not in entry[1]), None)
                rows += [(host, page, token, *entry, token == root) for token, entry in found.items()]
                page += 1
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], names=["host", "page", "token", "kind", "path", "times", "chars", "first_root"])


def region_of(paths: dict[str, int], total: int) -> str:
    """The deepest article or main element that holds enough of the text; without one, the whole page, since a path that holds
    most of the text need not hold the headings, lists and tables of the article."""
    enough = [p for p, chars in paths.items() if chars >= REGION_SHARE * total]
    marked = [p for p in enough if p.rsplit("/", 1)[-1].split(".")[0].split("#")[0] in ("article", "main")]
    return max(marked, key=lambda p: (p.count("/"), paths[p], p), default="")


def template_of(table: pa.Table) -> pa.Table:
    """One host's template from its frequent tokens: the article's region and the texts that are the same on all its pages."""
    rows = table.to_pylist()
    paths = {r["path"]: r["chars"] for r in rows if r["kind"] == TAG}
    total = max((r["host_chars"] for r in rows), default=0)
    region = region_of(paths, total)
    constant = [r for r in rows if r["kind"] == TEXT]
    inside = sum(r["chars"] for r in constant if within(r["path"], region))
    if inside > MOST_CONSTANT * paths.get(region, total):
        constant = [r for r in constant if not within(r["path"], region)]
    return pa.table({"host": pa.array([rows[0]["host"]], pa.string()), "region": pa.array([region], pa.string()), "constant": pa.array([[r["token"] for r in constant]], pa.list_(pa.int64()))})


def within(path: str, region: str) -> bool:
    return not region or path == region or path.startswith(region + "/")


def deduce_templates(pages: DataFrame) -> DataFrame:
    """``host, region, constant`` per host, from ``host, html``.

    A token's occurrence vector (its times on each page of the host) is known by a hash that is summed over pages, so a host of
    any size is aggregated in parts. Tokens of one host with the same vector are an equivalence class. A class is valid if it
    has a path token, lies on enough pages and its members nest: a text counts as part of the template only in a class that
    also holds a path around it. Per host only the tokens of valid classes meet.
    """
    tokens = stored(pages.mapInArrow(page_tokens, TOKENS), "page-tokens")
    roots = tokens.where((F.col("kind") == TAG) & ~F.col("path").contains("/"))
    sizes = roots.groupBy("host").agg(F.count(F.when(F.col("first_root"), 1)).alias("pages"), F.sum("chars").alias("host_chars"))
    vectors = tokens.groupBy("host", "token", "kind", "path").agg(F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.count("*").alias("on_pages"), F.sum("chars").alias("chars"))
    by_host = sizes.withColumnRenamed("host", "__host")
    frequent = vectors.join(by_host, F.col("host").eqNullSafe(F.col("__host"))).where((F.col("on_pages") >= LEAST_SHARE * F.col("pages")) | (F.col("kind") == TAG) & (F.col("chars") >= REGION_SHARE * F.col("host_chars")))
    frequent = stored(frequent.drop("__host"), "page-frequent")
    holders = frequent.where(f"kind = {TAG}").select(F.col("host").alias("__host"), F.col("vector").alias("__vector"), F.col("path").alias("__path"))
    texts = frequent.where((F.col("kind") == TEXT) & (F.col("on_pages") >= LEAST_PAGES)).join(
        holders, F.col("host").eqNullSafe(F.col("__host")) & (F.col("vector") == F.col("__vector")) & F.concat("path", F.lit("/")).startswith(F.concat("__path", F.lit("/"))), "left_semi",
    )
    kept = frequent.where(f"kind = {TAG}").unionByName(texts)
    return kept.select("host", "token", "kind", "path", "chars", "host_chars").groupBy("host").applyInArrow(template_of, "host string, region string, constant array<long>")


def article_of(html: str | None, region: str | None, constant: set[int]) -> str:
    """The blocks in the region that are neither noise nor part of the template; all regions count if the page has no such one."""
    blocks = [b for b in blocks_of(html) if not b.noise]
    inside = [b for b in blocks if within(b.path, region or "")] or blocks
    return "\n".join(b.text for b in inside if not constant or number("t", b.path, b.text) not in constant)


def extract_articles(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page: the main text, blocks joined by a line end.

    Templates come from all pages of a host; pages without a host share one. Menus, adverts and the like are known by their
    elements and by class, id and role words; the article's region and its constant texts by the host's template. On a host
    of one or few pages no text is constant. Null and empty pages give an empty text; unclosed elements end where HTML ends
    them; an unclosed script or comment runs to the end of the page.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), host_of(url_column).alias("host"))
    templates = stored(deduce_templates(rows.select("host", "html")), "page-templates").withColumnRenamed("host", "__host")
    joined = rows.join(templates, F.col("host").eqNullSafe(F.col("__host")), "left").select("page_id", "url", "html", "region", "constant")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = [article_of(h, r, set(c or ())) for h, r, c in zip(part["html"].to_pylist(), part["region"].to_pylist(), part["constant"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
