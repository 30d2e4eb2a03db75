"""Product data from a table of HTML pages, by pattern per field.

Patterns run in the JVM on the whole page. A field is the first group of its
pattern; the patterns avoid look-around, so any regex engine gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "N/A"


def text_of(css_class: str) -> str:
    """Pattern for the text right inside an element of the given class."""
    return rf'class="(?:[^"]* )?{css_class}(?: [^"]*)?"[^>]*>([^<]*)<'


@dataclass(frozen=True)
class PageSpec:
    """Where the fields are: blocks per page, text fields per block, and the star marker."""

    block: str | None = None
    fields: Mapping[str, str] = field(default_factory=dict)
    lists: Mapping[str, str] = field(default_factory=dict)
    link: str | None = None
    star: str | None = None


LISTING = PageSpec(
    block=r'(?s)<div class="product-card">(.*?)</div>',
    fields={name: text_of(f"product-{name}") for name in ("name", "price", "sold", "location")},
    link=r'<a [^>]*href="([^"]*)"',
    star=r'class="(star-active)"',
)
DETAIL = PageSpec(
    fields={
        "name": text_of("product-title"), "price": text_of("product-price"),
        "rating": text_of("rating-score"), "rating_count": text_of("rating-total"),
        "sold": text_of("product-sold"), "description": text_of("product-description"),
    },
    lists={"categories": r'<a class="breadcrumb"[^>]*>([^<]*)</a>'},
)
REVIEWS = PageSpec(
    block=r'(?s)<li class="review">(.*?)</li>',
    fields={name: text_of(f"review-{name}") for name in ("author", "content", "time")},
    star=r'class="(star-active)"',
)
# Pages without product markup: navigation links, headings and paragraphs carry the data.
GENERIC_LISTING = PageSpec(block=r"(<a href=[^<]*</a>)", fields={"name": r">([^<]*)</a>"}, link=r'href="([^"]*)"')
GENERIC_DETAIL = PageSpec(
    fields={"name": r"<title>([^<]*)</title>", "description": r"<h1>([^<]*)</h1>"},
    lists={"categories": r'<li><a href="[^"]*">([^<]*)</a></li>'},
)
GENERIC_REVIEWS = PageSpec(block=r"(<p>[^<]*</p>)", fields={"content": r"<p>([^<]*)</p>"})


def _field(source: Column, pattern: str) -> Column:
    found = F.trim(F.regexp_extract(source, pattern, 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(MISSING))


def _all(source: Column, pattern: str) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(1))


def _stars(source: Column, spec: PageSpec) -> Column:
    return F.size(_all(source, spec.star)) if spec.star else F.lit(0)


def _blocks(pages: DataFrame, blocks: Column) -> DataFrame:
    return pages.select("page_id", "url", F.posexplode(blocks).alias("position", "block"))


def extract_product_listing(
    pages: DataFrame, spec: PageSpec = LISTING, base_url: str = "", timestamp: Column | None = None
) -> DataFrame:
    """One row per product block of a listing page."""
    block = F.col("block")
    columns = [_field(block, pattern).alias(name) for name, pattern in spec.fields.items()]
    absent = [F.lit(MISSING).alias(n) for n in ("price", "sold", "location") if n not in spec.fields]
    href = F.regexp_extract(block, spec.link, 1)
    stamp = [] if timestamp is None else [timestamp.alias("timestamp")]
    return _blocks(pages, _all(F.col("html"), spec.block)).select(
        "page_id", "position", *columns, *absent,
        F.concat(F.lit(base_url), href).alias("url"), _stars(block, spec).alias("rating"), *stamp,
    )


def extract_product_detail(pages: DataFrame, spec: PageSpec = DETAIL) -> DataFrame:
    """One row per product page, breadcrumb categories as an array."""
    html = F.col("html")
    wanted = ("name", "price", "rating", "rating_count", "sold", "description")
    return pages.select(
        "page_id", "url",
        *[(_field(html, spec.fields[n]) if n in spec.fields else F.lit(MISSING)).alias(n) for n in wanted],
        *[F.transform(_all(html, p), lambda text: F.trim(text)).alias(n) for n, p in spec.lists.items()],
    )


def extract_reviews(pages: DataFrame, spec: PageSpec = REVIEWS, per_page: int | None = None) -> DataFrame:
    """Review blocks of each page: all, or the first ``per_page``."""
    block = F.col("block")
    wanted = {"username": "author", "comment": "content", "time": "time"}
    blocks = _all(F.col("html"), spec.block)
    if per_page is not None:
        blocks = F.slice(blocks, 1, per_page)
    return _blocks(pages, blocks).select(
        "page_id", "position",
        *[(_field(block, spec.fields[s]) if s in spec.fields else F.lit(MISSING)).alias(n) for n, s in wanted.items()],
        _stars(block, spec).alias("rating"),
    )
