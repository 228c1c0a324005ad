"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import blocks as B
from corpusgraph.llm import class_lm, decontamination, fingerprints, language_id, near_dedup, packing, substring_dedup, token_counts, toxicity, warc

SPACE = r"[\x20\x09-\x0D]+"
DDL = "doc_id long, text string, block int, shard int, keys string, lang string, source string, n_chars long"


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


def table(spark, rows):
    """Rows (doc_id, text), with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "x", "en", "s", 3) for i, t in rows], DDL)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, base = text(60), [text(r.randint(5, 200)) for _ in range(40)]
    near = base[3].split()
    near[5] = "changed"
    out = [*base, base[0], base[0], " ".join([text(30), shared, text(9)]), shared + "\n" + text(5), " ".join(near), "", None, "  \t ", "one", "Zwei Wörter ß", "x " * 3000, text(20_000)]
    return list(enumerate(out))


def test_empty_tables(spark):
    none = table(spark, [])
    path = public_tokenizers.path
    outs = [near_dedup.near_duplicate_classes(none), token_counts.count_tokens(none, path(token_counts.TOKENIZER)), fingerprints.fingerprints(none), class_lm.class_lm_scores(none, F.lit(True)), packing.pack(none, path(packing.TOKENIZER)), substring_dedup.remove_repeats(none), language_id.identify(none, F.lit(True))]
    outs += [decontamination.contaminated(none, spark.createDataFrame([], "item_id long, text string")), toxicity.toxicity_scores(none, spark.createDataFrame([], "doc_id long, toxic int")), warc.resolve(warc.page_captures(spark.createDataFrame([], "page_id long, url string, html string")))]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_packed_keys_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert (B.unpack_keys(B.pack_keys(keys)) == keys).all()


def test_substring_dedup(spark, rows):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, rows)).collect()}
    seen: set = set()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y)), i


def test_substring_dedup_null_and_equal_ids(spark):
    t = " ".join(f"w{i}" for i in range(25))
    got = substring_dedup.remove_repeats(table(spark, [(None, t), (1, t), (1, t)])).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=repr) == [(1, 0), (1, 25), (None, 25)]


def test_near_dedup(spark, rows):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(table(spark, rows)).collect()}
    data, off = B.text_arrays(pa.array([t for _, t in rows]))
    doc, sh, tf = near_dedup.shingle_sets(data, off, 5)
    _, inv = np.unique(sh, return_inverse=True)
    w = (1 + np.log(tf)) * (1 + near_dedup.IDF_SHARE * np.log(len(rows) / np.bincount(inv)[inv]) / np.log(len(rows)))
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    sets = [(sh[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    want = {}
    for i in range(len(rows)):
        mates = [j for j in range(i) if (len(sets[i][0]) and len(sets[j][0]) and near_dedup.weighted_jaccard(sets[i], sets[j]) >= 0.8) or not (len(sets[i][0]) or len(sets[j][0]))]
        want[i] = want[mates[0]] if mates else i
    assert got == want and got[44] == 3 and got[41] == 0


def _true_classes(rows, idf=near_dedup.IDF_SHARE):
    """Components of all pairs of 0.8 or more, by brute force."""
    doc, sh, tf = near_dedup.shingle_sets(*B.text_arrays(pa.array([t for _, t in rows])), 5)
    _, inv = np.unique(sh, return_inverse=True)
    w = (1 + np.log(tf)) * near_dedup.rarity(np.bincount(inv)[inv], len(rows), idf)
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    sets = [(sh[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    label, links = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                links += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label, links


@pytest.mark.parametrize("chunk", [512, 5])
def test_near_dedup_loses_no_link_in_groups_of_edited_copies(spark, monkeypatch, chunk):
    """Sixty groups of twelve copies with edits, many of them near the threshold; also with buckets over many chunks."""
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(60):
        base = [word() for _ in range(120)] + ["again and again and again"] * (g % 3)
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    want, links = _true_classes(rows)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicate_classes(table(spark, rows)).collect()}
    assert links > 500 and len(set(want)) > 65
    assert [got[i] for i, _ in rows] == want


def test_near_dedup_null_and_equal_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    got = near_dedup.near_duplicate_classes(table(spark, [(None, t), (5, t), (5, "other words here"), (7, t), (7, t), (9, None), (8, " ")])).collect()
    assert sorted(((x.doc_id, x.class_id) for x in got), key=repr) == [(5, 5), (5, 5), (7, 5), (7, 5), (8, 8), (9, 8), (None, None)]


@pytest.mark.parametrize("blocks", [1, 7, 5_000])
def test_range_blocks_follow_the_key(spark, blocks):
    docs = spark.range(20_000).select(F.when(F.col("id") % 97 == 0, None).otherwise(F.col("id") * 3 - 1000).alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(1).alias("other"))
    got = B.range_block(docs, blocks).orderBy(F.col("doc_id").asc_nulls_last()).select("doc_id", "block").collect()
    known = [x.block for x in got if x.doc_id is not None]
    assert known == sorted(known) and all(x.block > known[-1] for x in got if x.doc_id is None)
    n = len(set(known))
    assert 0.8 * blocks <= n <= 1.5 * blocks and max(collections.Counter(known).values()) <= 3 * 20_000 / blocks + 3


def test_near_dedup_compares_all_of_a_mixed_bucket(spark):
    """Texts that share much, though less than the threshold; the one alike pair has smaller and greater ids on both sides."""
    r = random.Random(15)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = text(150)
    tails = [text(30) for _ in range(24)]
    docs = [(i, shared + " " + t) for i, t in enumerate(tails)]
    near = docs[11][1].split()
    near[-2] = "changed"
    docs[12] = (12, " ".join(near))
    docs += [(100 + i, t) for i, t in enumerate(tails)]  # so that no shingle is of one text only
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicate_classes(table(spark, docs), bands=1, rows=1).collect()}
    assert got == {i: 11 if i == 12 else i for i, _ in docs}


def test_token_counts_and_packing(spark, rows):
    import sentencepiece
    from tokenizers import Tokenizer

    extra = ["a▁b  c", " x ", "<s>q</s>", "日本 é x<|endoftext|>y", "don't,Stop 12", "é,!̸"]
    docs = rows + [(1000 + i, t) for i, t in enumerate(extra)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.TOKENIZER))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(table(spark, docs), public_tokenizers.path(token_counts.TOKENIZER)).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in docs}
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pieces = packing.pack(table(spark, docs), public_tokenizers.path(packing.TOKENIZER)).collect()
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(p.length for p in pieces) // 4096) + 1
    crc = {(p.doc_id, p.piece): (p.start, p.length, p.ids_crc32) for p in pieces}
    want = {}
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, lo in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[lo : lo + 4096], "<u4")
            want[i, k] = (lo, len(part), zlib.crc32(part.tobytes()))
    assert crc == want


def test_plan_holds_each_piece_once():
    r = random.Random(2)
    for _ in range(20):
        counts = collections.Counter(r.choice([r.randint(1, 100), r.randint(1, 60)]) for _ in range(r.randint(1, 300)))
        back: collections.Counter = collections.Counter()
        for n, parts in packing.plan(dict(counts), 100):
            assert sum(parts) <= 100
            for p in parts:
                back[p] += n
        assert back == counts


def test_fingerprints(spark, rows):
    docs = rows + [(500, rows[0][1]), (None, "a b")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(spark, docs)).collect()}
    order = sorted((d for d in docs if d[0] is not None), reverse=True) + [(None, "a b")]
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = collections.Counter(words(t)), collections.Counter(words(edited))
        if a and b:
            assert abs(got[i].near_edited - sum((a & b).values()) / sum((a | b).values())) < 0.4
    assert got[500].fingerprint == got[0].fingerprint and got[45].fingerprint == "" and got[None].doc_id is None


def test_decontamination(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    items = [(k, text(40)) for k in range(12)] + [(90, None), (91, "")]
    docs = [(k, text(50) + " " + items[k][1].upper().replace(" ", ", ", 3) + "! " + text(20)) for k in range(6)]
    docs += [(10 + k, text(100)) for k in range(6)] + [(20, None), (21, ""), (None, items[7][1])]
    one = items[8][1].split()
    docs.append((30, " ".join([*one[:38], "zz", "zz"])))
    got = sorted(((x.doc_id, x.item_id) for x in decontamination.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == sorted([*((k, k) for k in range(6)), (None, 7), (30, 8)], key=repr)


def test_decontamination_against_all_windows(spark):
    """Swapped halves, insertions, gaps, clipped and repeated passages: as by brute force over every window."""
    r = random.Random(51)
    text = lambda n: ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    same = text(12)  # a passage that several items hold
    items = [(k, text(n)) for k, n in enumerate((100, 100, 60, 40, 40, 25, 80))] + [(20, same + text(30)), (21, same + text(33)), (21, text(30)), (None, text(35)), (30, text(3)), (31, None)]
    docs = []
    for _, w in items[:11]:
        h = len(w) // 2
        docs += [text(30) + w[h:] + w[:h] + text(9), w[h - 10 :] + w[: h - 10], text(5) + w[:h] + text(3) + w[h:] + text(40), text(8) + w + w[: h + 2] + text(5), w[len(w) // 8 :] + text(20), text(20) + w[: -len(w) // 12 or None], w[:h] + text(60) + w[h:]]
        copy = list(w)
        for _ in range(2):
            copy[r.randrange(len(w))] = "zz"
        docs.append(text(50) + copy + text(50))
    docs += [items[11][1], text(20) + items[11][1], same + text(50), same, text(200)]
    rows = [(k, " ".join(x)) for k, x in enumerate(docs)] + [(3, None), (3, " ".join(items[0][1])), (3, " ".join(items[0][1])), (None, "- ".join(items[1][1])), (None, "")]
    tables = [(k, None if w is None else " ".join(w)) for k, w in items]
    tables.append(tables[0])

    def shingled(t):
        w = re.findall("[a-z]+", t or "")
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])

    bench = {x: shingled(x[1]) for x in set(tables) if x[1]}
    df = collections.Counter(h for x in bench.values() for h in set(x))
    weight = lambda h: 1 + math.log(len(bench) / df[h]) if h in df else 1 + math.log(len(bench))
    want = {}
    for doc in set(rows):
        hs = shingled(doc[1])
        for (item_id, _), own in bench.items():
            b = collections.Counter(own)
            for at in range(1 - len(own), len(hs)):
                a = collections.Counter(hs[max(0, at) : at + len(own)])
                if a.keys() & b.keys():
                    low, high = (sum(f(a[h], b[h]) * weight(h) for h in a.keys() | b.keys()) for f in (min, max))
                    if low / high >= 0.8 and low / high > want.get((doc, item_id), (0,))[0] + 1e-12:
                        want[doc, item_id] = low / high, at
    found = decontamination.contaminated(table(spark, rows), spark.createDataFrame(tables, "item_id long, text string"))
    version = {x.version: x.text for x in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("version")).collect()}
    got = {((x.doc_id, version[x.version]), x.item_id): (x.similarity, x.start) for x in found.collect()}
    assert len(want) >= 50 and got.keys() == want.keys() and found.count() == len(got)
    assert all(math.isclose(got[k][0], want[k][0], rel_tol=1e-9) and got[k][1] == want[k][1] for k in want)


def test_multi_index_finds_all_within_radius(spark):
    r = random.Random(6)
    left = [r.getrandbits(63) for _ in range(60)]
    right = [x ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 30))) for x in left]
    got = decontamination.near_pairs(spark.createDataFrame([(x, 9) for x in left], "fp long, size int"), spark.createDataFrame([(x, 9) for x in right], "item_fp long, size int")).collect()
    assert {(x.fp, x.item_fp) for x in got} == {(a, b) for a in left for b in right if (a ^ b).bit_count() <= decontamination.RADIUS}


def test_class_lm(spark, rows):
    train = lambda i: i % 3 != 0
    got = {r.doc_id: r for r in class_lm.class_lm_scores(table(spark, rows), F.col("doc_id") % 3 != 0, top=20, classes=8).collect()}
    tok = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + ["\0"]
    c = collections.Counter(w for i, t in rows if train(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        x = tok(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(x), sum(w in c for w in x), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9) and got[i].score < 0


def test_class_lm_against_plain_counts(spark, rows, monkeypatch):
    """Units, classes of all words, transitions and scores word by word in plain Python; only the exchange itself is shared."""
    monkeypatch.setattr(class_lm, "CONTEXTS_AT_A_TIME", 7)
    top_n, k = 20, 8
    docs = [(i, t) for i, t in rows[:48] if t is None or len(t) < 4000] + [(None, rows[1][1]), (2, rows[2][1])]
    known = lambda i: i is None or i % 3 != 0
    found = class_lm.class_lm_scores(table(spark, docs), F.col("doc_id") % 3 != 0, top=top_n, classes=k).collect()
    data, off = B.text_arrays(pa.array([t for _, t in docs]))
    key, doc = class_lm.word_keys(data, off)
    texts = [[int(x) for x in key[doc == i]] for i in range(len(docs))]
    train = [t for (i, _), t in zip(docs, texts, strict=True) if known(i)]
    c = collections.Counter(w for t in train for w in t)
    top = sorted(sorted(c, key=lambda w: (-c[w], w - 2**64 if w >= 2**63 else w))[:top_n])
    end = len(top) + class_lm.SHAPES
    unit = lambda w: top.index(w) if w in top else len(top) + w % class_lm.SHAPES
    pairs = np.zeros((end + 1, end + 1))
    for t in train:
        chain = [end, *map(unit, t), end]
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            pairs[a, b] += 1
    cls = class_lm.exchange(pairs, k)
    g = np.zeros((k, k))
    for a in range(end + 1):
        for b in range(end + 1):
            g[cls[a], cls[b]] += pairs[a, b]
    size = g.sum(0)
    step = class_lm.smoothed(g)
    of = {w: int(cls[unit(w)]) for t in texts for w in t}
    worth = {w: -c[w] * np.log(np.maximum(size, 1)) for w in c}
    for t in train:
        chain = [int(cls[end]), *(int(cls[unit(w)]) for w in t), int(cls[end])]
        for j, w in enumerate(t, 1):
            worth[w] = worth[w] + step[chain[j - 1]] + step[:, chain[j + 1]]
    of |= {w: int(np.argmax(np.round(worth[w], 6))) for w in c if w not in top and c[w] >= class_lm.RARE}
    moves, tokens, kinds = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in train:
        chain = [int(cls[end]), *(of[w] for w in t), int(cls[end])]
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            moves[a, b] += 1
    for w, n in c.items():
        tokens[of[w]] += n
        kinds[of[w]] += 1
    tokens[cls[end]] += len(train)
    kinds[cls[end]] += 1
    n, v, step = sum(c.values()) + len(train), len(c) + 1, np.exp(class_lm.smoothed(moves))
    want = []
    for (i, _), t in zip(docs, texts, strict=True):
        before, score = int(cls[end]), 0.0
        for a, count in [*((of[w], c[w]) for w in t), (int(cls[end]), len(train))]:
            emit = (count + class_lm.DELTA) / (tokens[a] + class_lm.DELTA * (kinds[a] + 1))
            score += math.log10(class_lm.MIX * step[before, a] * emit + (1 - class_lm.MIX) * (count + 1) / (n + v + 1))
            before = a
        want.append((repr(i), len(t) + 1, score))
    assert len(set(of.values())) > 3
    for a, b in zip(sorted(want), sorted((repr(r.doc_id), r.n_tokens, r.score) for r in found), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-6), (a, b)


def test_exchange_joins_words_of_one_kind():
    pairs = np.zeros((6, 6))
    pairs[:3, 3:], pairs[3:, :3] = 50, 50
    cls = class_lm.exchange(pairs, 2)
    assert len(set(cls[:3])) == 1 and len(set(cls[3:])) == 1 and cls[0] != cls[3]


def test_language_id(spark):
    r = random.Random(7)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(40))
    docs = [(i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(60)] + [(100, None, "aa"), (101, "123 !", None), (102, make("abcde") + " " + "vwxyz " * 5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(df, F.col("doc_id") % 5 != 0).collect()}
    assert all(got[i][0] == lang for i, _, lang in docs[:60])
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "aa" and 0.5 < got[102][1] < 1


def test_automaton_is_levenshtein_one():
    a = toxicity.Automaton(["idiot", "fool"], ["verq"])
    exact, near, none = ["idiot", "fool", "verq", "verqab"], ["idlot", "idot", "idioot", "idiots", "diiot"[1:] and "idiott"], ["foll", "verx", "idi", "idxxt", "", "iddioot", "xfool", "xxidiot"]
    assert a.match("xidiot") == 1  # a letter before the first
    assert [a.match(w) for w in exact] == [2] * 4 and [a.match(w) for w in near] == [1] * 5 and [a.match(w) for w in none] == [0] * 8


def test_automaton_agrees_with_edit_distance():
    r = random.Random(12)
    terms = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 8))) for _ in range(40)})
    a = toxicity.Automaton(terms, [])

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = _row(row, c, y, i)
        return row[-1]

    def _row(row, c, y, i):
        out = [i]
        for j, d in enumerate(y, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
        return out

    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "a", "b", "e"])
        w = "".join(w)
        want = 2 if w in terms else int(any(len(t) >= toxicity.FUZZY_LENGTH and distance(w, t) == 1 for t in terms))
        assert a.match(w) == want, w


def test_mixture_agrees_with_plain_em():
    """Proportions and the chosen set of languages, word by word in plain Python."""
    r = np.random.default_rng(3)
    k, docs = 5, [3, 40, 1, 200, 90]
    doc = np.repeat(np.arange(len(docs)), docs)
    loglik = r.normal(-8, 2, (len(doc), k))
    for i, tongues in enumerate([[0], [1, 2], [3], [0, 1, 2, 4], [2, 3, 4]]):
        for j in np.flatnonzero(doc == i):
            loglik[j, tongues[j % len(tongues)]] += 9
    best, share = language_id.mixture(loglik, doc, len(docs) + 1)
    for i in range(len(docs)):
        like = np.exp(np.maximum(loglik[doc == i] - loglik[doc == i].max(1, keepdims=True), -60))

        def em(allowed):
            pi = [1 / len(allowed) if x in allowed else 0.0 for x in range(k)]
            for _ in range(language_id.STEPS):
                new = [0.0] * k
                for row in like:
                    z = sum(pi[x] * row[x] for x in range(k))
                    for x in range(k):
                        new[x] += pi[x] * row[x] / z / len(like)
                pi = new
            return pi, sum(math.log(max(1e-30, sum(pi[x] * row[x] for x in range(k)))) for row in like)

        order = sorted(range(k), key=lambda x: -em(range(k))[0][x])
        rated = []
        for size in range(1, k + 1):
            pi, ll = em(order[:size])
            rated.append((ll - 0.5 * size * math.log(len(like)), pi))
        _, pi = max(rated, key=lambda x: x[0])
        assert best[i] == int(np.argmax(pi)) and abs(share[i] - max(pi)) < 1e-3
    assert best[-1] == -1 and share[-1] == 0


def test_toxicity_learns(spark):
    r = random.Random(8)
    text = lambda: [("".join(r.choice("abcdefgh") for _ in range(5))) for _ in range(30)]
    docs, labels = [], []
    for i in range(160):
        t, bad = text(), i % 4 == 0
        if bad:
            t[7] = "idiot!"
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs += [(900, " ".join([*text(), "idi0t"])), (901, None), (902, "")]
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(table(spark, docs), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int").where("doc_id is null or doc_id < 120")).collect()}
    assert min(got[i] for i in range(120, 160, 4)) > 0.5 > max(got[i] for i in range(121, 160, 4)) and got[901] == got[902] < 0.3 and len(got) == 163


def test_toxicity_finds_misspelled_words_of_stems(spark):
    r = random.Random(9)
    text = lambda: [("".join(r.choice("abcdefgh") for _ in range(5))) for _ in range(30)]
    bad = ["worthless", "pathetic", "stupid", "stupidly", "stupidity"]
    docs = []
    for i in range(240):
        t = text()
        if i % 4 == 0:
            t[7] = bad[i // 4 % 5]
        docs.append((i, " ".join(t)))
    forms = ["worhless", "worthlezs", "pthetic", "pathetlc", "stvpid", "stupiditty"]
    docs += [(900 + k, " ".join([*text(), w])) for k, w in enumerate(forms)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(table(spark, docs[:240]).join(labels, "doc_id"))
    assert lexicon == (sorted(bad), ["stupi"])
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(table(spark, docs), labels).collect()}
    assert min(got[900 + k] for k in range(len(forms))) > 0.5 > max(got[i] for i in range(240) if i % 4)


def test_warc_round_trip_and_revisits(spark):
    raw = warc.encode_record("response", "http://a.b/", "2020-01-01T00:00:00Z", "<1>", {"ETag": '"x"'}, b"body\r\n\r\nWARC/1.1") + warc.encode_record("revisit", "http://a.b", "2020-01-02T00:00:00Z", "<2>", {}, status=304)
    got = list(warc.decode_records(raw))
    assert [(g["kind"], g["http_status"], g["headers"], g["body"]) for g in got] == [("response", 200, {"etag": '"x"'}, b"body\r\n\r\nWARC/1.1"), ("revisit", 304, {}, b"")]
    caps = [(1, "http://WWW.a.b:80/p/?b=2&ref=x&a=1#f", 10, False, {"etag": '"x"', "server": "s"}), (2, "https://a.b/p?a=1&b=2", 20, True, {"etag": 'W/"x"', "server": "no", "date": "d"}), (3, "a.b/p?a=1&b=2", 5, True, {"etag": '"x"'}), (4, "http://a.b/p?a=1&b=2", 30, True, {"etag": '"y"'}), (5, "http://a.b/p?a=1&b=2", 31, True, None), (6, None, None, True, None)]
    out = {x.seq: (x.status, x.source_seq, x.headers) for x in warc.resolve(spark.createDataFrame(caps, "seq long, url string, ts long, is_revisit boolean, headers map<string,string>")).collect()}
    assert out[1][0] == "full" and out[2] == ("resolved", 1, {"etag": 'W/"x"', "server": "s", "date": "d"})
    assert [out[k][0] for k in (3, 4, 5, 6)] == ["orphan", "changed", "unvalidated", "orphan"]


def test_pipeline_stages(spark, tmp_path, rows):
    import corpus_pipeline

    docs = table(spark, rows).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(rows[10][1].split()[:60])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.collect()}
    assert kept == {i for i, t in rows if re.search("[a-zß]", t or "") and i not in (10, 40, 41, 44)}
