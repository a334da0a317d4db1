"""The training-data operators: brute force, exact round trips, held-out accuracy, and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import compare
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import bpe, chat, crf_quality, exact_dedup, line_dedup, mixing, near_dedup, queries, sharding, substring_dedup, weak_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SOME = " ".join(f"alpha{i} beta{i}" for i in range(60))
#: nulls in any column, empty and white texts, ties, repeated rows and a very long text
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, SOME, "en", "a", 1), (5, SOME, "de", None, 1),
    (5, SOME, "de", None, 1), (None, SOME + " tail", "en", "b", 1), (7, LONG, "en", "b", 1), (8, "one two three", None, "c", 13),
    (9, "x" * 9000, "en", "c", 9000), (10, "Ünï çødé 😀 <|endoftext|> & <|im_end|>", "en", "c", 1),
]


def edge(spark):
    # further columns with the names that operators use inside
    return spark.createDataFrame(EDGE, DOCS).selectExpr("*", "'z' as _t", "7 as h", "1 as t", "2L as pos", "'q' as a", "3 as _id", "4 as size", "5 as kept")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert not compare.differences(queries.QUERIES[name](spark, SF), compare.database(SF), queries.ORACLES[name])


def every(spark, docs):
    """What each operator makes of docs."""
    import public_tokenizers as p

    ranks = p.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(4, 1), (8, 0), (9, None), (None, 1)], "doc_id long, quality int")
    return {
        "shards": sharding.shard_equal_texts(docs),
        "crf": crf_quality.score(docs, crf_quality.train(docs, labels)),
        "exact": exact_dedup.exact_dedup(docs),
        "mix": mixing.mix(docs),
        "near": near_dedup.near_duplicates(docs),
        "rules": weak_rules.judge(docs),
        "windows": substring_dedup.substring_dedup(docs),
        "bpe": bpe.round_trip(docs, ranks, p.PATTERN),
        "lines": line_dedup.line_dedup(docs),
    }


def test_edge_cases_keep_all_rows(spark):
    docs = edge(spark)
    for name, out in every(spark, docs).items():
        assert Counter(r["doc_id"] for r in out.collect()) == Counter(x[0] for x in EDGE), name
    for name, out in every(spark, empty(spark)).items():
        assert out.collect() == [], name


def test_edge_cases_of_stages(spark):
    docs = edge(spark)
    for keep in (weak_rules.keep_good, exact_dedup.keep_first, near_dedup.keep_one, mixing.repeated):
        assert keep(docs).columns == docs.columns
        assert keep(empty(spark)).count() == 0


def test_shards(spark):
    rows = queries.op1_shard_by_label_propagation(spark, SF).collect()
    sizes, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and max(abs(x - mean) for x in sizes.values()) < 0.1 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(g) == 1 for g in groups.values()) > 0.95 * len(groups)


def test_propagation_cuts_few_links(spark):
    nodes = spark.range(2000).selectExpr("id as node", "10L as size")
    links = spark.range(2000).filter("id % 10 <> 0").selectExpr("id as a", "id - 1 as b")
    placed = {r["node"]: r["shard"] for r in sharding.propagate(nodes, links, 4).collect()}
    cut = sum(placed[i] != placed[i - 1] for i in range(2000) if i % 10)
    assert cut < 0.4 * 1800 and max(Counter(placed.values()).values()) <= 600


def test_chat(spark):
    turns = [(1, 1, "user", "hi & <|im_sep|>"), (1, 0, "system", None), (1, 2, "assistant", "a"), (1, 3, "assistant", "b&lt;|"), (1, 3, "assistant", "b&lt;|"), (2, None, None, ""), (None, 0, "us\ner", "<|im_end|>\n<|im_start|>assistant\nok")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert out[1]["loss_sha256"] == sha("ab&lt;|b&lt;|") and out[1]["n_turns"] == 5
    assert out[1]["turns_sha256"] == sha("system\n\nuser\nhi & <|im_sep|>\nassistant\na\nassistant\nb&lt;|\nassistant\nb&lt;|\n")
    assert out[None]["turns_sha256"] == sha("us\ner\n<|im_end|>\n<|im_start|>assistant\nok\n") and out[None]["loss_chars"] == 0
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_crf_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op3_crf_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and quality is not null")
    rows = out.select("quality", "score", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_exact_with_colliding_identifiers(spark):
    texts = ["a b", "a  b", "a c", "a\tb", "", None, " ", "\n", "b a"] + [f"{i} t" for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = exact_dedup.exact_dedup(docs, chunk_hash=lambda c: F.length(c).cast("long"))
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = {i: (g[0], len(g), i == g[0]) for g in groups.values() for i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()} == want


def test_mix(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    taken, target, most = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(7)).collect()), key=repr)


def _weights(docs):
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in docs if (w := words(t))}
    df = Counter(s for c in sets.values() for s in c)
    n = len(docs)
    import math

    idf = lambda s: 1 + math.log(n / max(df[s], near_dedup.FREQUENT * n))
    return {i: {s: c * idf(s) for s, c in x.items()} for i, x in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    base = [[f"v{r.randrange(4000)}" for _ in range(r.randrange(60, 160))] for _ in range(60)]
    docs = []
    for k, b in enumerate(base):
        for j in range(4):
            c = list(b)
            for _ in range(j * len(b) // 90):
                c[r.randrange(len(c))] = f"e{r.randrange(10**6)}"
            docs.append((4 * k + j, " ".join(c)))
    docs += [(900, ""), (901, None), (902, "few words"), (903, "few  words"), (904, docs[0][1])]
    out = {x["doc_id"]: x for x in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    w = _weights(docs)
    at = list(w)
    linked = {i: i for i in at}

    def find(i):
        while linked[i] != i:
            i = linked[i]
        return i

    pairs = [(a, b) for x, a in enumerate(at) for b in at[x + 1 :]]
    for a, b in pairs:
        least = sum(min(w[a][s], w[b].get(s, 0)) for s in w[a])
        if least >= (0.8 - 1e-9) * (sum(w[a].values()) + sum(w[b].values()) - least):
            linked[find(b)] = find(a)
    together = lambda f: {(a, b) for a, b in pairs if f(a) == f(b)}
    want, got = together(find), together(lambda i: out[i]["class_id"])
    assert got <= want and len(got) >= 0.97 * len(want) and want
    assert out[900]["class_id"] == out[901]["class_id"] == 900 and out[903]["class_id"] == 902 and out[904]["class_id"] == 0
    assert sum(x["kept"] for x in out.values()) == len({x["class_id"] for x in out.values()})


def test_prefix_filter_finds_all_across_components(spark):
    """Texts that meet in no band are joined by the filter alone if they are alike."""
    r = random.Random(7)
    b = [f"v{i}" for i in range(100)]
    docs = [(bytes([k]), " ".join(b if k == 0 else b[:at] + [f"n{k}"] + b[at + 1 :])) for k in range(12) for at in [r.randrange(10, 90)]]
    texts = spark.createDataFrame(docs, "t binary, text string")
    weights = near_dedup.document_frequencies(texts)
    met = texts.selectExpr("0 as band", "0L as key", "t", "X'00' as a")
    sims = texts.filter("t <> X'00'").selectExpr("X'00' as a", "t as b", "0.9D as sim")
    labels = texts.limit(0).selectExpr("t", "t as c")
    got = {(bytes(x["a"]), bytes(x["b"])) for x in near_dedup._across(met, sims, labels, texts, weights).collect()}
    sets = {t: near_dedup.shingles([x])[1][0] for t, x in docs}
    want = {(a, c) for a in sets for c in sets if a < c and near_dedup.similarity(sets[a], sets[c], weights) >= 0.8}
    assert want and want <= got


def test_rules_measures(spark):
    docs = edge(spark)
    for r in weak_rules.judge(docs).collect():
        texts = [t for i, t, *_ in EDGE if i == r["doc_id"]]
        w = words(texts[0])
        lines = [x for x in (texts[0] or "").split("\n") if words(x)]
        triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), sum((texts[0] or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(r[m] for m in weak_rules.MEASURES) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_em_finds_bad_patterns():
    n = len(weak_rules.RULES)
    patterns = [("G" * n, 900), ("B" * 4 + "G" * (n - 4), 60), ("G" * (n - 1) + "B", 40), ("-" * n, 10)]
    e = weak_rules.estimate(patterns)
    good, bad, one, none = e.posterior([p for p, _ in patterns])
    assert good > 0.9 and bad < 0.1 and none > 0.5 and e.share > 0.8
    assert (weak_rules.estimate(patterns[::-1]).posterior([p for p, _ in patterns]) == pytest.approx([good, bad, one, none]))


@pytest.mark.parametrize("length", [4, 35])
def test_windows_against_brute_force(spark, length):
    r = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    texts = [[f"u{r.randrange(10**6)}" for _ in range(r.randrange(80))] for _ in range(40)]
    texts = [t + shared[r.randrange(10) : r.randrange(40, 60)] * r.randrange(3) + t[:5] for t in texts] + [shared, shared, [], ["a"] * 90]
    docs = [(i, "  ".join(t) + "\n") for i, t in enumerate(texts)] + [(99, None)]
    count = Counter(tuple(t[k : k + length]) for t in texts for k in range(len(t) - length + 1))
    want = {99: (0, 0, "")}
    for i, t in enumerate(texts):
        gone = {k + j for k in range(len(t) - length + 1) if count[tuple(t[k : k + length])] > 1 for j in range(length)}
        want[i] = (len(t), len(gone), " ".join(w for k, w in enumerate(t) if k not in gone))
    out = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), length)
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in out.collect()} == want


def test_bpe_is_that_of_tiktoken(spark):
    import base64

    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = edge(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = Counter()
    for d, t in texts:
        ids = known.encode_ordinary(t)
        want[(d, len(ids), sha(" ".join(map(str, ids))), sha(t))] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, path, p.PATTERN).collect())) == want


def test_pipeline_against_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in weak_rules.judge(docs).filter("kept").collect()}
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert out and out <= kept
    rest = docs.filter(F.col("doc_id").isin(sorted(kept)))
    first = {r["doc_id"] for r in exact_dedup.exact_dedup(rest).filter("kept").collect()}
    near = {r["doc_id"] for r in near_dedup.near_duplicates(rest.filter(F.col("doc_id").isin(sorted(first)))).filter("kept").collect()}
    mixed = {r["doc_id"] for r in mixing.mix(docs.filter(F.col("doc_id").isin(sorted(near)))).filter("times > 0").collect()}
    assert out == mixed
