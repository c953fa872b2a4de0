import hashlib
import zlib

import pytest

from pagewright.llm import op3_media as m
from tests.llm import edge


def test_sequences():
    page = '<title>T</title><p>one <b>bold</b><br>two<script>x("<p>")</script><figure><img src="sha256:AB" alt="alt"><img src="b.png"><figcaption>Cap <i>tion</i></figcaption></figure><p>three<img src="sha256:cd" alt="own">'
    got = [(x["pos"], x["kind"], x["text"], x["digest"], x["caption"]) for x in m.read_sequence(page)]
    assert got == [(0, "text", "T", None, None), (1, "text", "one bold", None, None), (2, "text", "two", None, None), (3, "media", "sha256:AB", "ab", "Cap tion"), (4, "media", "b.png", None, "Cap tion"), (5, "text", "three", None, None), (6, "media", "sha256:cd", "cd", "own")]
    assert m.read_sequence(None) == m.read_sequence("") == []
    assert [x["kind"] for x in m.read_sequence("<p>a<figure><img src=x></p><unclosed")] == ["text", "media", "text"]  # an unfinished tag is text


def test_query(spark):
    p = edge.by_id(m.op3_interleaved_media(spark, "/root/testdata/sf0.001"))
    d = edge.by_id(edge.table(spark, "documents"))
    assert p["doc_id"].tolist() == d["doc_id"].tolist()
    for row, text in zip(p.itertuples(), d["text"], strict=True):
        raw = text.encode()
        data = raw + b" " * (-len(raw) % 192) or b" " * 192
        stored = b"P6\n64 %d\n255\n" % (len(data) // 192) + data
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (row.media_pos >= 1 or not text.strip()) and row.caption == f"Document of {row.n_bytes} bytes"
    assert p.assign(t=d["text"]).groupby("t")["feature"].nunique().max() == 1


def test_broken_media_are_noticed(spark):
    good = b"P6\n64 1\n255\n" + b"x" * 192
    with pytest.raises(ValueError, match="whole"):
        m.read_pixmap(good[:-1])
    bad = spark.createDataFrame([("00", good)], "digest string, media binary")
    with pytest.raises(Exception, match="differ from their digests"):
        m.media_features(bad).collect()


def test_edges(spark, tmp_path):
    for name, df in (("edge", edge.docs(spark)), ("none", edge.empty(spark))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    out = m.op3_interleaved_media(spark, str(tmp_path / "edge")).toPandas()
    assert len(out) == len(edge.ROWS)
    assert (out[out["n_bytes"] == 0]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()).all()
    assert m.op3_interleaved_media(spark, str(tmp_path / "none")).count() == 0
    pages = m.interleave(edge.table(spark, "pages"))
    assert pages.filter("size(sequence) = 0").count() == 0
