"""Operators that SQL cannot express against plain versions of the same, over all cases or all rows."""

import hashlib
import itertools
import math
import random
import re
import struct
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import chat, common, crf_quality, exact_dedup, hashing, line_dedup, mixing, near_dedup, sharding, substring_dedup, weak_rules

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op1


def spark_hash(node, salt):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", node), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", salt), seed=seed)
    return h - (1 << 64) if h >= 1 << 63 else h


def dealt(node, salt, bins=sharding.BINS):
    return spark_hash(node, salt) % bins


def plain_propagation(nodes, links, shards, rounds=sharding.ROUNDS, slack=sharding.SLACK):
    """Rounds of requests and grants, then nodes without links to even out. nodes: node -> size."""
    beside = defaultdict(set)
    for a, b in links:
        beside[a].add(b)
        beside[b].add(a)
    at = {n: dealt(n, -1, shards) for n in nodes}
    mean = sum(nodes.values()) / shards

    def loads():
        out = [0] * shards
        for n, s in at.items():
            out[s] += nodes[n]
        return out

    idle = 0
    for r in range(rounds):
        asked = defaultdict(list)
        for n in beside:
            count = Counter(at[m] for m in beside[n])
            to = max(count, key=lambda s: (count[s], -s))
            gain = count[to] - count[at[n]]
            if gain > 0 and dealt(n, r, 2) == 0:
                asked[to, max(0, 7 - gain) * (sharding.BINS // 8) + dealt(n, r, sharding.BINS // 8)].append(n)
        if not asked:
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        quota = [max(0.0, mean * (1 + slack) - x) for x in loads()]
        for to, b in sorted(asked):
            z = sum(nodes[n] for n in asked[to, b])
            if z <= quota[to]:
                quota[to] -= z
                for n in asked[to, b]:
                    at[n] = to
    for k, step in enumerate(("free", "free", "free", "pieces", "pieces", "free")):
        now = loads()
        off = max(abs(x - mean) for x in now)
        if off <= mean * 1e-4 or k >= 3 and off <= mean * 0.02:
            break
        bins = defaultdict(list)
        for n, s in at.items():
            if now[s] > mean and (step == "pieces" or n not in beside):
                bins[s, dealt(n, 101 + k)].append(n)
        sizes = {key: sum(nodes[n] for n in ns) for key, ns in bins.items()}
        for s, b in sorted(bins, key=lambda key: (-sizes[key], key)):
            to = min(range(shards), key=now.__getitem__)
            if now[s] - mean >= sizes[s, b] / 2 and mean - now[to] >= sizes[s, b] / 2:
                now[s] -= sizes[s, b]
                now[to] += sizes[s, b]
                for n in bins[s, b]:
                    at[n] = to
    return at


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_is_the_plain_one(spark, seed):
    r = random.Random(seed)
    nodes = {i: r.randrange(1, 9) for i in range(90)}
    links = {(a, b) for a in range(60) for b in r.sample(range(a // 10 * 10, a // 10 * 10 + 10), 3) if a != b}
    got = sharding.propagate(spark.createDataFrame(list(nodes.items()), "node long, size long"), spark.createDataFrame(sorted(links), "a long, b long"), 3)
    assert {x["node"]: x["shard"] for x in got.collect()} == plain_propagation(nodes, links, 3)


def test_small_graphs_against_the_least_cut(spark):
    """Over all even divisions of small graphs in two: cliques are not cut, and a random graph's cut is near the least one."""
    r = random.Random(4)
    cliques = [(a, b) for k in range(4) for a in range(3 * k, 3 * k + 3) for b in range(a + 1, 3 * k + 3)]
    loose = sorted({tuple(sorted(r.sample(range(12), 2))) for _ in range(16)})
    for links, most in ((cliques, 0), (loose, None)):
        cut = lambda at: sum(at[a] != at[b] for a, b in links)  # noqa: E731, B023
        least = min(cut({n: int(n in half) for n in range(12)}) for half in map(set, itertools.combinations(range(12), 6)))
        pieces = {n: n // 3 * 3 for n in range(12)} if most == 0 else {n: n for n in range(12)}
        df = spark.createDataFrame([(n, 10, pieces[n]) for n in range(12)], "node long, size long, piece long")
        at = {x["node"]: x["shard"] for x in sharding.propagate(df, spark.createDataFrame(links, "a long, b long"), 2, slack=0.2).collect()}
        assert cut(at) <= (least if most == 0 else 2 * least + 2) and set(Counter(at.values()).values()) <= {5, 6, 7}


def test_a_group_of_nearly_a_shard_is_whole(spark):
    texts = ["the same text " * 20] * 70 + [f"alone {i} " * 28 for i in range(730)]
    out = sharding.shard_equal_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r["shard"] for r in out if r["doc_id"] < 70}) == 1
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 8


# --- op2


def test_the_mask_is_used(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a < b | & c"), (1, 2, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns)
    assert chat.digests(chats).first()["loss_sha256"] == sha("a < b | & c<|im_end|>")
    moved = chats.withColumn("mask", F.transform("mask", lambda r: F.struct((r["skip"] + 1).alias("skip"), r["chars"].alias("chars"), r["loss"].alias("loss"))))
    far = chats.withColumn("mask", F.transform("mask", lambda r: F.struct((r["skip"] + 999).alias("skip"), r["chars"].alias("chars"), r["loss"].alias("loss"))))
    assert chat.digests(moved).first()["loss_sha256"] != sha("a < b | & c<|im_end|>")
    with pytest.raises(Exception, match="does not fit"):
        chat.digests(far).collect()


# --- op3


def test_forward_backward_over_all_labellings():
    r = np.random.default_rng(3)
    counts = np.array([1, 4, 7, 2])
    e, trans = r.normal(size=counts.sum()), r.normal(size=(2, 2))
    good, pairs, log_z = np.zeros(len(e)), np.zeros((2, 2)), 0.0
    for a, n in zip(np.cumsum(counts) - counts, counts):
        total = 0.0
        own, moves = np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(e[a + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            own += w * np.array(y)
            for i in range(n - 1):
                moves[y[i], y[i + 1]] += w
        good[a : a + n] = own / total
        pairs += moves / total
        log_z += math.log(total)
    got = crf_quality.forward_backward(e, trans, counts)
    assert np.allclose(got[0], good) and np.allclose(got[1], pairs) and abs(got[2] - log_z) < 1e-9


def test_fit_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(3, "y"), (4, None), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1)], "doc_id long, quality int")
    every = crf_quality.training_rows(docs, labels).collect()
    assert len(every) == len({r["doc_id"] for r in every}) and {r["doc_id"]: r["text"] for r in every}[3] == "y"
    few = crf_quality.training_rows(docs, labels, limit_bytes=1000).collect()
    assert 8 <= len(few) <= 12 and {r["doc_id"] for r in few} < {r["doc_id"] for r in every} and all(len(r["text"]) in (0, 1, 100) for r in few)
    assert len(crf_quality.training_rows(docs, labels, limit=7).collect()) == 7


# --- op5


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_water_filling_by_rounds(spark, n):
    r = random.Random(n)
    size = {(f"s{i:04d}" if i else None): r.choice([0, 1, 5, 50, 1000, 20000]) for i in range(n)}
    got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long"), [3.0, 1.0, 2.0], 1.5, 2.0).collect()}
    w = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        rest = [s for s in size if s not in full]
        rate = max(total - sum(2 * size[s] for s in full), 0) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * rate > 2 * size[s]]
        if not over:
            break
        full |= set(over)
    assert got == pytest.approx({s: 2.0 * size[s] if s in full else w[s] * rate for s in size})


# --- op6


def weighted(texts, floor):
    sets = near_dedup.shingles(texts)[1]
    df, n = Counter(), len(texts)
    for h, _ in sets:
        df.update(h.tolist())
    idf = {h: 1 + math.log(n / max(k, floor * n)) for h, k in df.items()}
    return [dict(zip(h.tolist(), (c * np.array([idf[x] for x in h.tolist()])).tolist())) for h, c in sets]


def classes(texts, floor=0.0):
    """The class of each text (the first place in it) by all pairs that share a shingle, and the number of linked pairs."""
    w = weighted(texts, floor)
    places = defaultdict(list)
    for i, x in enumerate(w):
        for h in x:
            places[h].append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    empty = [i for i, x in enumerate(w) if not x]
    links = 0
    for i, x in enumerate(w):
        shared = Counter(j for h in x for j in places[h] if j > i)
        for j in shared:
            least = sum(min(v, w[j].get(h, 0)) for h, v in x.items())
            if least >= (0.8 - 1e-9) * (sum(x.values()) + sum(w[j].values()) - least):
                root[max(find(i), find(j))] = min(find(i), find(j))
                links += 1
    for i in empty:
        root[i] = empty[0]
    return [find(i) for i in range(len(texts))], links


def test_few_texts_have_plain_weights(spark):
    """Up to 1 / FREQUENT texts the floor of document frequencies changes nothing: the classes are those of plain TF-IDF."""
    r = random.Random(8)
    texts = []
    for k in range(10):
        base = [f"w{k}x{i}" for i in range(100)]
        for j in range(4):
            copy = list(base)
            for at in r.sample(range(100), j):
                copy[at] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    assert len(texts) <= 1 / near_dedup.FREQUENT
    own, links = classes(texts, 0.0)
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(own)) and links and len(set(own)) >= 10


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_duplicates_of_documents(spark, sf):
    """All pairs of the tables, with the floor of document frequencies."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    own, _ = classes([r["text"] or "" for r in rows], near_dedup.FREQUENT)
    want = {r["doc_id"]: rows[c]["doc_id"] for r, c in zip(rows, own)}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    pairs = lambda f: {(a, f[a]) for a in f if f[a] != a}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.97 * len(pairs(want)) and pairs(want)


# --- op7


def test_expectation_maximisation_by_document(spark):
    """Rounds over documents one by one, not over patterns of votes."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    votes = {}
    for i, t in docs:
        m, looks = weak_rules.measure(t or "")
        votes[i] = weak_rules.votes(m[0], looks)
    n = len(weak_rules.RULES)
    share, on_good, on_bad = 0.85, [0.99] * n, [0.2] * n

    def posterior(v):
        odds = math.log(share / (1 - share))
        for k, c in enumerate(v):
            if c == "G":
                odds += max(math.log(on_good[k] / (1 - on_bad[k])), 0)
            elif c == "B":
                odds += min(math.log((1 - on_good[k]) / on_bad[k]), 0)
        return 1 / (1 + math.exp(-odds))

    for _ in range(100):
        p = {i: posterior(v) for i, v in votes.items()}
        share = min(max((sum(p.values()) + 17) / (len(p) + 20), 0.02), 0.98)
        for k in range(n):
            said = [(p[i], v[k]) for i, v in votes.items() if v[k] != "-"]
            right = sum(x for x, c in said if c == "G")
            wrong = sum(1 - x for x, c in said if c == "B")
            on_good[k] = min(max((right + 19.8) / (sum(x for x, _ in said) + 20), 0.01), 0.999)
            on_bad[k] = min(max((wrong + 4) / (sum(1 - x for x, _ in said) + 20), 0.01), 0.999)
    for r in weak_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert r["p_good"] == pytest.approx(posterior(votes[r["doc_id"]]), abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


# --- op8


def test_both_hashes_tell_windows_apart():
    r = random.Random(2)
    w = hashing.Words([" ".join(r.choice("abc") for _ in range(400))])
    seen = [tuple(w.raw[w.starts[i] : w.ends[i + 4]] for _ in (0,)) for i in range(396)]
    for family in (0, 1):
        h, ok = w.windows(5, family)
        assert len(set(h[:396].tolist())) == len(set(seen)) and ok[:396].all()
    assert (w.windows(5, 0)[0][:396] != w.windows(5, 1)[0][:396]).all()


def test_no_window_repeats(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(5)] + [(9, "a b"), (9, "a b"), (None, None)], "doc_id long, text string")
    out = substring_dedup.substring_dedup(docs).collect()
    assert len(out) == 8 and not any(r["n_removed"] for r in out) and substring_dedup.levels(140) == [18, 35, 70, 140]


# --- op10


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "a", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, n_lines int, n_dropped string")
    out = line_dedup.line_dedup(docs).orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "n_lines_", "n_dropped_"]
    assert [tuple(r) for r in out.collect()] == [(1, "a", 7, "x", 1, 0), (2, "", 8, "y", 1, 0)]


# --- all together


def test_the_repeated_rows_of_one_id(spark):
    rows = [(1, "A text"), (2, "A text"), (2, "other text entirely"), (3, "x"), (3, "x")]
    for keep in (exact_dedup.keep_first, near_dedup.keep_one):
        out = keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, out)) == [(1, "A text"), (2, "other text entirely"), (3, "x")]


def test_a_cluster_needs_a_shared_folder():
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, other: other)))


def test_pipeline_against_plain_python(spark, tmp_path):
    """Whole rows and how often each comes, over the smallest table with repeated rows, null ids and shared ids put in."""
    import base64

    import public_tokenizers as p
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("length(text) between 400 and 3000").orderBy("doc_id").limit(12)
    more = [F.lit(None).cast("long"), F.lit(3).cast("long"), F.col("doc_id")]
    for k in more:
        docs = docs.union(some.withColumn("doc_id", k).select(docs.columns))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    verdicts = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"], r["n_dup_lines"]): r["kept"] for r in weak_rules.judge(docs).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    measured = {t: weak_rules.measure(t or "")[0] for _, t, _ in rows}
    kept = [r for r in rows if verdicts[(r[0], measured[r[1]][0], measured[r[1]][1], measured[r[1]][2], measured[r[1]][4], measured[r[1]][3])]]
    last = lambda i: (i is None, i)
    first = {}
    for r in sorted(set(kept), key=lambda r: last(r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    unique = list(first.values())
    # the floor is a share of the texts of this stage
    own, _ = classes([r[1] for r in unique], near_dedup.FREQUENT)
    groups = defaultdict(list)
    for r, c in zip(unique, own):
        groups[c].append(r)
    near = [min(g, key=lambda r: (last(r[0]), sha(r[1]))) for g in groups.values()]
    place = lambda i: int(hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest()[:9], 16)
    by_source = defaultdict(list)
    for r in near:
        by_source[r[2]].append(r)
    sizes = {s: sum(len(words(r[1])) for r in g) for s, g in by_source.items()}
    plan = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [3.0, 1.0, 2.0], 1.5, 2.0).collect()}
    times = {}
    for s, g in by_source.items():
        whole = min(int(plan[s] // sizes[s]), 2) if sizes[s] else 0
        need, so_far = plan[s] - whole * sizes[s], 0
        for u, same in itertools.groupby(sorted(g, key=lambda r: place(r[0])), key=lambda r: place(r[0])):
            same = list(same)
            z = sum(len(words(r[1])) for r in same)
            for r in same:
                times[r] = whole + (need > 0 and so_far + z / 2 <= need)
            so_far += z
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r, n in times.items():
        ids = known.encode_ordinary(r[1])
        if n:
            want[r[0], len(ids), sha(" ".join(map(str, ids))), sha(r[1])] += n
    assert got == want and sum(want.values()) > 50


def test_values_of_edge_rows(spark):
    """Nulls, empty and white texts, repeated rows, a null id, a very long text and clashing names: every operator's values, row by row."""
    import zlib

    import test_llm

    docs, rows = test_llm.edge(spark), [(x[0], x[1] or "", x[3]) for x in test_llm.EDGE]
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    of = lambda key: {k: [r for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    least = lambda group: min((r[0] for r in group if r[0] is not None), default=None)

    same = of(lambda r: flat(r[1]))
    want = Counter((i, least(same[flat(t)]), len(same[flat(t)]), i == least(same[flat(t)]), sha(flat(t))) for i, t, _ in rows)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want

    out = line_dedup.line_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == Counter((i, t, t.count("\n") + 1, 0) for i, t, _ in rows)

    count = Counter(tuple(w[k : k + 35]) for _, t, _ in rows for w in [words(t)] for k in range(len(w) - 34))
    want = Counter()
    for i, t, _ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs).collect())) == want

    own, _ = classes([t for _, t, _ in rows], near_dedup.FREQUENT)
    members = defaultdict(list)
    for r, c in zip(rows, own):
        members[c].append(r)
    want = Counter((r[0], least(members[c]), len(members[c]), r[0] == least(members[c])) for r, c in zip(rows, own))
    assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == want

    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    for r in mixing.mix(docs).collect():
        assert (r["size"], r["source_size"]) in {(len(words(t)), sizes[r["source"]]) for i, t, s in rows if i == r["doc_id"] and s == r["source"]}
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 2

    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in rows)
    shards = sharding.shard_equal_texts(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in shards) == want
    assert {r["law"] for r in shards} == {"bytes"} and {r["grown_shard"] for r in shards} == {None}

    scores = defaultdict(set)
    for r in crf_quality.score(docs, crf_quality.fit(["good text here.", "##$$%%"], [1, 0])).collect():
        scores[r["doc_id"]].add((r["score"], r["predicted"], r["held_out"]))
    assert scores[4] and {s for s, _, _ in scores[4]} == {s for s, _, _ in scores[5]} and {h for _, _, h in scores[None]} == {None}
