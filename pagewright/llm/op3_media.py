"""Interleaved document sequences: HTML becomes ordered text and media references, which digests resolve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, keep, ship, table, utf8

#: A stored image: a binary pixmap 64 pixels wide, three 8-bit samples a pixel, so 192 bytes a row.
ROW_BYTES = 192
SEQUENCE = "array<struct<pos int, kind string, text string, digest string, caption string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

#: Tags whose content is no text, and tags that end a run of text.
HIDDEN = {"script", "style", "template", "noscript"}
BLOCK = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "blockquote", "pre", "title", "body", "figure"}
MEDIA = {"img", "video", "audio", "source"}


class _Reader(HTMLParser):
    """Collects [kind, text, digest, caption] in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def end_run(self) -> None:
        text = "".join(self.run).strip()
        self.run.clear()
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA:
            self.end_run()
            got = dict(attrs)
            src = got.get("src") or ""
            self.items.append(["media", src or None, src[7:].lower() if src.startswith("sha256:") else None, (got.get("alt") or "").strip() or None])
        elif tag == "figcaption":
            self.end_run()
            self.caption = []
        elif tag in BLOCK:
            self.end_run()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :] if said and self.figure is not None else []:
                if item[0] == "media":
                    item[3] = said
        elif tag in BLOCK:
            self.end_run()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def read_sequence(html: str | None) -> list[dict]:
    """Text runs and media references of a page in order, each media item with its digest and caption."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end_run()
    return [dict(zip(("pos", "kind", "text", "digest", "caption"), (i, *item), strict=True)) for i, item in enumerate(reader.items)]


def interleave(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add `sequence` to pages: the ordered items of each page. A null or empty page has none.

    Malformed HTML gives what can be read, an unfinished tag at the end as text; text in scripts and styles is left out. A figure's caption
    goes to all media in the figure, else the media's own alternative text is its caption.
    """
    ship(pages.sparkSession)

    @F.pandas_udf(SEQUENCE)
    def sequence(html: pd.Series) -> pd.Series:
        return html.map(read_sequence)

    return pages.withColumn("sequence", sequence(F.col(html_col)))


def payload(text: Column) -> Column:
    """A text's UTF-8 bytes with spaces appended up to a positive multiple of 192."""
    n = F.length(utf8(text))
    full = F.greatest(F.ceil(n / ROW_BYTES), F.lit(1)) * ROW_BYTES
    return F.concat(utf8(text), utf8(F.repeat(F.lit(" "), (full - n).cast("int"))))


def pixmap(samples: Column) -> Column:
    """The stored form of a payload: a portable pixmap (P6) of 64 pixels a row."""
    height = F.floor(F.length(samples) / ROW_BYTES).cast("string")
    return F.concat(utf8(F.concat(F.lit("P6\n64 "), height, F.lit("\n255\n"))), samples)


def read_pixmap(stored: bytes) -> bytes:
    """The samples of a stored pixmap; raises if it isn't whole."""
    magic, shape, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, shape.split())
    if (magic, depth) != (b"P6", b"255") or len(samples) != 3 * width * height:
        raise ValueError("not a whole 8-bit pixmap")
    return samples


def describe(stored: bytes) -> tuple:
    """Payload and media facts of one stored object, and its feature: 8x8 mean-brightness bits and the mean of each colour."""
    samples = read_pixmap(stored)
    rgb = np.frombuffer(samples, np.uint8).reshape(-1, 64, 3)
    grey = rgb.mean(axis=2, dtype=np.float64)
    rows = np.minimum(np.arange(len(grey)) * 8 // len(grey), 7)
    cells = np.zeros((8, 8))
    np.add.at(cells, rows, grey.reshape(len(grey), 8, 8).mean(axis=2))
    cells /= np.maximum(np.bincount(rows, minlength=8), 1)[:, None]
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    means = "-".join(f"{m:.3f}" for m in rgb.reshape(-1, 3).mean(axis=0, dtype=np.float64))
    return len(samples), sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), sha256(stored).hexdigest(), f"{bits}:{means}"


def media_features(store: DataFrame) -> DataFrame:
    """Read the stored bytes of a media table (digest, media) back: a row of features for each digest, with its copies.

    An object whose bytes don't have its digest raises an error.
    """
    ship(store.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *describe(m)) for d, m in zip(pdf["digest"], pdf["media"], strict=True)]
            if bad := [r[0] for r in rows if r[0] != r[5]]:
                raise ValueError(f"stored media differ from their digests: {bad[:3]}")
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    rows = store.select("digest", "media").mapInPandas(read, FEATURES)
    keys = rows.columns
    return rows.groupBy(*keys).agg(F.count("*").alias("copies"))


def resolve(pages: DataFrame, features: DataFrame, page_cols: list[str]) -> DataFrame:
    """Join the media items of pages(.., sequence) with their features by digest.

    Returns page_cols, pos, caption and the features' columns. References without a digest, or to
    media that aren't stored, have no row. One digest may have a third of all references.
    """
    refs = pages.select(*page_cols, F.explode("sequence").alias("item")).filter("item.digest is not null").select(*page_cols, "item.pos", "item.caption", "item.digest")
    refs = keep(refs, "media-refs")
    return join_by_key(refs, features, "digest", "copies", refs.count()).drop("copies")


def op3_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pages of their text and a figure that holds the text's bytes as an image."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    media = pixmap(payload(F.col("body")))
    store = keep(docs.select(F.sha2(media, 256).alias("digest"), media.alias("media")), "media-store")
    escaped = F.replace(F.replace(F.coalesce("body", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="sha256:'), F.sha2(media, 256), F.lit('"><figcaption>Document of '), F.length(utf8(F.col("body"))).cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    pages = docs.select("doc_id", F.length(utf8(F.col("body"))).cast("long").alias("n_bytes"), html.alias("html"))
    found = resolve(interleave(pages), keep(media_features(store), "media-features"), ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("pos").alias("media_pos"), "caption")
