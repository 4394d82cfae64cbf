"""Fingerprints of texts against a plain count of bits."""

from collections import Counter
from hashlib import md5

from kinsight.functions import simhash
from kinsight.sources import catalog


def plain(tokens):
    bits = [0] * 60
    for t, n in Counter(tokens).items():
        h = int(md5(t.encode()).hexdigest()[:15], 16)
        for b in range(60):
            bits[b] += n if h >> b & 1 else -n
    return sum(1 << b for b in range(60) if bits[b] > 0)


def test_prints_of_awkward_texts(spark, tmp_path, monkeypatch):
    """One pass of a kernel, no row a word; a text of one word, of none, of more words than a lane counts, of two rows."""
    texts = ["", "Word", "a  b", " É a-z ÉÉ zz", "same " * 700 + "end", " ".join(f"w{k % 37}" for k in range(2000)), None]
    rows = [(k, t, None if t is None else len(t)) for k, t in enumerate(texts)] + [(None, "x", 1), (50, "one two", 7), (50, "three", 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    made = catalog.prints(spark, f"file://{tmp_path}")
    got = {r.file_key: r for r in made.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 50} and made.count() == 8
    for k, t in enumerate(texts[:-1]):
        w = t.lower().split(" ")
        assert (got[k].dhash, got[k].phash) == (plain(w), plain([f"{a} {b}" for a, b in zip(w, w[1:])] or w))
        assert got[k].thumb16 == [t.lower().count(c) * 1000 // max(1, len(t)) for c in "abcdefghijklmnopqrstuvwxyz"]
    assert (got[50].dhash, got[50].phash) == (plain(["one", "two", "three"]), plain(["one two", "three"]))
    monkeypatch.setattr(simhash, "KNOWN", 2)
    hasher = simhash.Hasher()
    for t in ("a b c", "c d", "a b c"):
        words, _ = hasher.both([t])
        assert sum(1 << b for b in range(60) if words[0][b] > 0) == plain(t.split())
