"""op9: a result doesn't depend on what lies beside a text.  op10: what follows broken bytes is read."""

import gzip
import itertools

import numpy as np
import pytest

from corpusgraph.llm import language_id, warc


def _texts(rng, n, k):
    out = []
    for _ in range(n):
        words, own = rng.integers(1, 40), rng.permutation(k)[: rng.integers(1, 4)]
        ll = rng.normal(-4, 1, (words, k))
        ll[np.arange(words), rng.choice(own, words)] += rng.choice([0.5, 2.0, 5.0])
        out.append(ll)
    return out


def test_alone_and_together_agree_bit_by_bit():
    rng = np.random.default_rng(1)
    texts = _texts(rng, 300, 5)
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    best, share = language_id.mixture(np.concatenate(texts), doc, len(texts))
    for i, ll in enumerate(texts):
        b, s = language_id.mixture(ll, np.zeros(len(ll), int), 1)
        assert b[0] == best[i] and s[0] == share[i]


def test_sets_need_not_be_nested():
    """Against all sets of languages, by the same EM: add and drop steps reach the best penalised likelihood nearly always."""
    rng = np.random.default_rng(2)
    texts, same = _texts(rng, 150, 4), 0
    for ll in texts:
        like = np.exp(ll - ll.max(1, keepdims=True))
        found = []
        for size in range(1, 5):
            for s in itertools.combinations(range(4), size):
                pi = np.zeros(4)
                pi[list(s)] = 1 / size
                for _ in range(language_id.STEPS):
                    post = like * pi
                    pi = (post / post.sum(1, keepdims=True)).mean(0)
                found.append((np.log((like * pi).sum(1)).sum() - 0.5 * size * np.log(len(ll)), pi.argmax()))
        same += max(found)[1] == language_id.mixture(ll, np.zeros(len(ll), int), 1)[0][0]
    assert same >= 148


def _record(k, body=b"hello", **headers):
    return gzip.decompress(warc.encode_record("response", f"http://a/{k}", "2024-01-01", f"<{k}>", {"ETag": str(k), **headers}, body))


@pytest.mark.parametrize("packed", [False, True])
def test_a_broken_record_in_the_middle(packed):
    good = [_record(k, b"x" * k * 100) for k in range(6)]
    bad_length = _record(9).replace(b"Content-Length: ", b"Content-Length: x")
    bad_status = _record(8).replace(b"HTTP/1.1 200", b"HTTP/1.1 2oo")
    parts = [good[0], b"junk\r\nmore junk\r\n", good[1], bad_length, good[2], bad_status, good[3], good[4], good[5][:-30]]
    raw = b"".join(map(gzip.compress, parts)) if packed else b"".join(parts)
    rows = list(warc.decode_records(raw))
    fine = [r for r in rows if not r["problem"]]
    assert [r["record_id"] for r in fine] == ["<0>", "<1>", "<2>", "<8>", "<3>", "<4>"]
    assert [r["http_status"] for r in fine] == [200, 200, 200, None, 200, 200] and fine[1]["body"] == b"x" * 100
    assert len([r for r in rows if r["problem"]]) == 3


def test_broken_gzip_members():
    members = [gzip.compress(_record(k)) for k in range(4)]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 255
    rows = list(warc.decode_records(members[0] + bytes(broken) + members[2] + members[3][:-12]))
    ids = [r["record_id"] for r in rows if not r["problem"]]
    assert ids[0] == "<0>" and "<2>" in ids and sum(bool(r["problem"]) for r in rows) >= 2
    assert list(warc.decode_records(b"")) == []


def test_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(_record(k)) for k in range(300)) + b"tail")
    (tmp_path / "b.warc").write_bytes(_record(1000) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sum(r["problem"] is None for r in got) == 301 and sum(r["problem"] is not None for r in got) >= 2
    assert {r["headers"]["etag"] for r in got if r["problem"] is None} == {str(k) for k in [*range(300), 1000]}


def test_ties_and_null_times(spark):
    schema = "seq long, url string, ts long, is_revisit boolean, headers map<string,string>"
    rows = [
        (1, "http://a/", None, False, {"ETag": "n"}), (2, "http://a/", 5, False, {"ETag": "one"}), (3, "http://a/", 5, True, {"etag": "one"}), (4, "http://a/", 5, False, {"ETag": "two"}),
        (5, "http://a/", 5, True, {"ETAG": "W/two"}), (6, "http://a/", None, True, {"etag": "n"}), (7, None, 9, True, {"etag": "n"}), (8, "http://b/", 1, True, None),
    ]
    got = {r["seq"]: (r["status"], r["source_seq"]) for r in warc.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("full", None), 2: ("full", None), 3: ("resolved", 2), 4: ("full", None), 5: ("resolved", 4), 6: ("resolved", 1), 7: ("orphan", None), 8: ("orphan", None)}
