"""op11 to op13 against brute force, and their defined cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from corpusgraph.llm import filter_audit, prefix_trie, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, part string"


def docs(spark, rows):
    """Rows (doc_id, text, source); block and part are columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, 0, 7, "x") for i, t, s in rows], DOCS)


# op11


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    mask = []
    for (i, t, _), w in zip(rows, words, strict=True):
        t = t or ""
        smaller = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)
        mask.append([len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller])
    out = []
    for part in {s or "" for *_, s in rows}:
        own = [k for k, (*_, s) in enumerate(rows) if (s or "") == part]
        gone = collections.Counter()
        steps = []
        for order in itertools.permutations(range(5)):
            left = list(own)
            for n, f in enumerate(order):
                removed = [k for k in left if mask[k][f]]
                fails = [k for k in own if mask[k][f]]
                left = [k for k in left if not mask[k][f]]
                gone[f] += len(removed)
                alone = sum(sum(mask[k]) == 1 for k in fails)
                steps.append((f, (part, "".join("ABCDE"[x] for x in order), n + 1, len(left), len(removed), len(fails) - len(removed), alone, sum(rows[k][0] in good for k in removed), sum(rows[k][0] in toxic for k in removed))))
        out += [(*row, gone[f]) for f, row in steps]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(1)
    text = lambda n, extra="": " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(n)) + extra
    rows = [(k, text(rng.randrange(1, 120), rng.choice(["", " #x", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"])), rng.choice(["a", "b", None, ""])) for k in range(60)]
    rows += [(100 + k, rows[k % 5][1], "a") for k in range(20)]  # copies
    rows += [(None, rows[0][1], "b"), (None, "only null", "b"), (None, "only null", "c"), (200, None, None), (201, "", "a"), (200, None, "a"), (3, rows[3][1], "b")]
    labels = [(k, k % 2, (k + 1) % 3) for k in range(0, 70, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1)]
    got = filter_audit.audit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == cols
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []).limit(0), none).count() == 0
    one = filter_audit.audit(docs(spark, [(1, None, None)]), none).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


# op12


def brute_bytes(rows, length=50):
    first, out = {}, []
    for i, t in rows:
        raw, key = (t or "").encode(), (i is None, i or 0)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            first[w] = min(first.get(w, key), key)
    for i, t in rows:
        raw, key = (t or "").encode(), (i is None, i or 0)
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < key:
                gone[s : s + length] = [True] * length
        spans, at = [], 0
        for g, run in itertools.groupby(gone):
            n = len(list(run))
            spans += [(at, at + n)] if g else []
            at += n
        out.append((i, len(raw), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def passages(rng, n):
    letters = "abcdefghijklmnopqrstuvwxyz éü日"
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [make(rng.randrange(30, 120)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = "".join(rng.choice([make(rng.randrange(5, 80)), rng.choice(shared), rng.choice(shared)[: rng.randrange(30, 100)]]) for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.3:  # an edited copy
            k = rng.randrange(len(t) + 1)
            out.append(t[:k] + rng.choice(["", "x", "ä"]) + t[k + 1 :])
        out.append(t)
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 50), (3, 33), (4, 64)])
def test_suffix_dedup(spark, seed, length):
    rng = random.Random(seed)
    texts = passages(rng, 120)
    rows = [(rng.choice([k, k, k, k // 3, None]), t, "s") for k, t in enumerate(texts)]
    rows += [(1000, "a" * 400, "s"), (1001, "b" * 49, "s"), (1002, "a" * 130, "s"), (1003, None, "s"), (1004, "", "s"), (1005, texts[0], "s"), (1005, texts[0], "s"), (1006, "ab" * 100, "s"), (1007, "ba" * 60, "s")]
    got = suffix_dedup.remove_repeats(docs(spark, rows), length)
    assert got.columns == ["doc_id", "n_bytes", "removed", "kept"]
    assert sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in got.collect()), key=repr) == brute_bytes([r[:2] for r in rows], length)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs(spark, []), 20)


def test_units_of_a_text_longer_than_a_piece(monkeypatch):
    """Units cover each window once, also where a text is scanned in pieces; equal windows have equal anchors."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (900, 49, 50, 0, 333)]
    texts.append(texts[0][100:700])
    table = pa.table({"block": pa.array([0] * len(texts), pa.int32()), "doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    anchors = {}
    for size in (1 << 18, 97):
        monkeypatch.setattr(suffix_dedup.B, "RUN_BYTES", size)
        block = suffix_dedup.Block(table, 50)
        starts = [s for a, b in zip(block.first, block.last, strict=True) for s in range(a, b + 1)]
        assert starts == [o + s for o, t in zip(block.off, texts, strict=False) for s in range(len(t) - 49)]
        for a, b, g in zip(block.first, block.last, block.gram, strict=True):
            for s in range(a, b + 1):
                assert anchors.setdefault(block.data[s : s + 50].tobytes(), g) == g


# op13


def brute_trie(rows):
    def digest(r, t):
        return hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()

    own, members, kids, out = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(list), []
    for c, turn, r, t in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(r or "", t or ""), r or "", t or ""))
    own = {c: [x[3:] for x in sorted(s)] for c, s in own.items()}
    whole = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + s[h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, name long, depth int"


@pytest.mark.parametrize("bits", [64, 3])
def test_trie(spark, bits):
    """With three bits nearly all fingerprints collide, and groups must be split."""
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(200), 70):
        for k in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "user", None]), rng.choice(["hi", "how are you", "", None, "well\tthen "]), 1, 2))
    rows += [rows[0], (None, 0, "user", "hi", 1, 2), (20, 0, "user", "x", 1, 2), (-7, 0, "user", "hi", 1, 2), (-20, 0, "user", "hi", 1, 2)]
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS), bits=bits)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie([r[:4] for r in rows])


def test_trie_of_a_conversation_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(c, k, "user", f"t{k if k < 90 + c else -k}", 1, 2) for c in (0, 1, 25) for k in range(100)]
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie([r[:4] for r in rows])


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, 2)], TURNS)).count() == 0
