"""Sharding, phrases and spelling variants against SQL and plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import oracle
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from textloom.llm import collocations, queries, sharding, spelling
from textloom.llm.sharding import Tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("size", "slot", "shard", "region", "word", "n", "key", "phrase", "k", "a", "b", "rank", "root", "form", "total", "cut")
LONG = " ".join(f"word{i % 977}x" for i in range(30_000)) + " " + "q" * 5_000


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, "one two, one two. ÀÉ ûber " * 6, "en", "a", 1),
        (1, "one two, one two. ÀÉ ûber " * 6, "en", "a", 1),
        (1, "another text of the same id", None, "a", 1),
        (2, None, None, None, None),
        (None, "no id here\x0band\ttabs\x85stay", "en", None, 3),
        (None, None, None, "b", None),
        (3, "", "fr", "b", 0),
        (4, " \t\r\n \x0b\x0c .,;", "en", "c", 2),
        (5, LONG, "xx", "c", 1),
        (6, LONG, "und", "c", 1),
        (8, "Variante variante " * 15 + "varianté varianté", "de", "c", 1),
        (7, "日本 \U0001f600 " * 12, None, "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_shards", "op12_collocations", "op13_spelling_variants"])
def test_edge_tables_match_sql(spark, edge, nothing, name, tmp_path):
    """Null ids, null, empty and very long texts, repeated rows, clashing columns; then no rows at all."""
    for label, docs in (("edge", edge), ("nothing", nothing)):
        docs.write.parquet(str(tmp_path / label / "documents.parquet"))
        con = oracle.duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{label}/documents.parquet/*.parquet'")
        problem = oracle.compare(queries.QUERIES[name](spark, str(tmp_path / label)), con, queries.ORACLES[name])
        empty = label == "nothing"
        assert problem == ("the check has no rows" if empty else None)
        assert not empty or queries.QUERIES[name](spark, str(tmp_path / label)).count() == 0


# --- sharding ----------------------------------------------------------------------


def plain_shard(key, tree):
    def draw(name, weight):
        digits = int(hashlib.md5(f"{'' if key is None else key}:{name}".encode()).hexdigest()[:12], 16)
        return -math.log((digits + 0.5) / 16**12) / weight

    def winner(prefix, weights):
        return min((draw(f"{prefix}{i}", w), i) for i, w in enumerate(weights) if w > 0)[1]

    region = winner("", [sum(sum(rack) for rack in racks) for racks in tree.regions])
    rack = winner(f"{region}/", [sum(r) for r in tree.regions[region]])
    leaf = winner(f"{region}/{rack}/", tree.regions[region][rack])
    before = [s for racks in tree.regions[:region] for r in racks for s in r] + [s for r in tree.regions[region][:rack] for s in r]
    return len(before) + leaf


def shards_of(spark, keys, tree):
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    found = rows.select("doc_id", sharding.descend(F.col("doc_id"), tree)["shard"].alias("s")).collect()
    return {r["doc_id"]: r["s"] for r in found}


def test_descent_equals_plain_python(spark):
    tree = Tree((((1.0, 2.0), (0.5,)), ((3.0, 0.0, 1.0),)))
    keys = [None, *range(400)]
    assert shards_of(spark, keys, tree) == {k: plain_shard(k, tree) for k in keys}


def test_growth_moves_rows_into_the_new_shard_only(spark):
    tree, keys = Tree.even(3, 2, 4), range(6_000)
    before = shards_of(spark, keys, tree)
    assert set(before.values()) == set(range(24))
    for _ in range(3):
        new, tree = tree.size, tree.grow()
        after = shards_of(spark, keys, tree)
        moved = [k for k in keys if before[k] != after[k]]
        assert moved and all(after[k] == new for k in moved)
        assert abs(len(moved) - len(keys) / tree.size) < 5 * math.sqrt(len(keys) / tree.size)
        before = after


def test_other_weight_moves_rows_of_its_subtree_only(spark):
    tree, keys = Tree.even(3, 2, 4), range(6_000)
    before, heavy = shards_of(spark, keys, tree), tree.reweigh(9, 3.0)
    after = shards_of(spark, keys, heavy)
    for k in keys:
        if before[k] // 8 != after[k] // 8:  # other regions give to region 1 and take nothing
            assert after[k] // 8 == 1
        elif before[k] // 4 != after[k] // 4:  # within region 1 its other rack gives only
            assert after[k] // 4 == 2
        elif before[k] != after[k]:
            assert after[k] == 9
    exchanged = {(r["shard"], r["new_shard"]): r["n"] for r in sharding.moves(spark.range(6_000).toDF("doc_id"), tree, heavy).collect()}
    assert exchanged == Counter((before[k], after[k]) for k in keys)


def test_weights_give_shares(spark):
    tree = Tree((((1.0, 2.0), (1.0,)), ((4.0,),)))
    n = Counter(shards_of(spark, range(8_000), tree).values())
    for shard, share in enumerate((1000, 2000, 1000, 4000)):
        assert abs(n[shard] - share) < 5 * math.sqrt(share)


def test_tree_refuses_bad_weights():
    for weights in (((0.0,),), ((-1.0, 2.0),)):
        with pytest.raises(ValueError):
            Tree((weights,))


def test_slots_have_no_gaps_with_hot_rows(spark):
    rows = [(1, "copy")] * 5_000 + [(2, f"text {i}") for i in range(3_000)] + [(i, "t") for i in range(3, 4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.assign(docs, Tree.even(3, 2, 4), block=64).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(t) + 8) for i, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["text_crc32"] >= 0
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_written_shards_hold_whole_rows(spark, edge, tmp_path):
    path = str(tmp_path / "out")
    docs = edge.drop("shard")
    sharding.write_shards(docs, Tree.even(2, 1, 2), path, files=2)
    back = spark.read.schema(StructType([*docs.schema.fields, StructField("shard", IntegerType())])).parquet(path)
    assert Counter(map(tuple, back.drop("shard").collect())) == Counter(map(tuple, docs.collect()))
    assert all(r["shard"] == plain_shard(r["doc_id"], Tree.even(2, 1, 2)) for r in back.select("doc_id", "shard").collect())


# --- phrases -----------------------------------------------------------------------


def plain_phrases(docs, longest, least, covered):
    f, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    rows = []
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and p in {q[i : i + len(p)] for i in range(len(q))} for q, b in able.items()):
                continue
            score, _, left, right = min(
                (10**6 * a * a // (counts[p[:c]] * counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p))
            )
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored), 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return rows


@pytest.mark.parametrize("longest, least, block", [(3, 10, 1 << 20), (4, 3, 50), (2, 2, 7)])
def test_phrases_equal_plain_python(spark, longest, least, block):
    random.seed(longest)
    words = ["a", "B", "c", "dé", "ß", "e-f", "x"]
    docs = []
    for i in range(300):
        text = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(random.randint(0, 60)))
        docs.append((text if i % 50 else None, "en" if i % 3 else random.choice(["de", None, "und"])))
    docs.append(("hot hot hot " * 500, "en"))
    table = spark.createDataFrame(docs, "text string, lang string")
    found = collocations.collocations(table, longest=longest, least=least, best=None, block_size=block)
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_phrases(docs, longest, least, collocations.COVERED))


def test_only_the_best_of_a_language_return(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i} v{i}." for i in range(40)), lang) for lang in ("x", "y") for _ in range(10)], "text string, lang string")
    found = collocations.collocations(docs, best=5).collect()
    assert sorted((r["lang"], r["rank"]) for r in found) == [(lang, rank) for lang in ("x", "y") for rank in range(1, 6)]
    assert sorted(r["phrase"] for r in found if r["lang"] == "x") == sorted(f"w{i} v{i}" for i in range(40))[:5]


def test_bitmap_finds_what_python_hashes(spark):
    groups = [("en", "a b"), ("dé", "ß"), ("und", "日本 x")] + [("en", f"w{i}") for i in range(500)]
    bits = collocations.bitmap(spark.createDataFrame(groups, "lang string, phrase string"))
    marks = {int(h) % collocations.BITS for lang, phrase in groups for h in collocations.phrase_hashes(lang, [phrase.encode()])}
    first, last = (collocations.phrase_hashes("en", [p]) for p in (b"a b", b"c"))
    assert collocations.longer_hashes(first, last) == collocations.phrase_hashes("en", [b"a b c"])
    assert {w * 32 + b for w in bits.nonzero()[0].tolist() for b in range(32) if bits[w] >> b & 1} == marks


# --- spelling variants -------------------------------------------------------------


def is_one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, noise):
    n = Counter()
    for i, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and is_one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), near


@pytest.mark.parametrize("noise", [None, 3, 31])
def test_variants_equal_plain_python(spark, noise):
    random.seed(5)
    base = ["".join(random.choice("abéß") for _ in range(random.randint(6, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaab", "abababab"]
    words = Counter()
    for w in base:
        words[w] += random.choice([2, 2, 30, 400])
        for _ in range(4):  # variants by each kind of edit, at every place
            at = random.randint(0, len(w) - 1)
            words[random.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "é" + w[at + 1 :], w + "a"])] += random.choice([2, 3, 25])
    bag = [w for w, c in words.items() for _ in range(c)]
    random.shuffle(bag)
    docs = [(i // 2 if i % 7 else None, " ".join(bag[i * 20 : i * 20 + 20]).replace("a", "A", i % 2)) for i in range(len(bag) // 20 + 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    wanted, near = plain_variants(docs, noise)
    found = spelling.spelling_variants(table, noise=noise).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(wanted, key=repr)
    assert sum(map(len, near.values())) > 100 and any(w[2] != w[0] for w in wanted)


def test_every_pair_one_edit_apart_shares_a_stretch(spark):
    """All words of eight letters over two letters, with all their neighbours of seven and nine."""
    words = ["".join("ab"[i >> k & 1] for k in range(length)) for length in (7, 8, 9) for i in range(1 << length)]
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    found = {(r["a"], r["b"]) for r in spelling.near_words(table).collect()}
    wanted = set()
    for w in words:
        cuts = {w[:i] + w[i + 1 :] for i in range(len(w))}
        wanted |= {tuple(sorted((w, c))) for c in cuts if len(c) >= 7}
        wanted |= {tuple(sorted((w, w[:i] + "ab"[w[i] == "a"] + w[i + 1 :]))) for i in range(len(w))}
    assert found == wanted


def test_pivots_are_the_cheapest_disjoint_places():
    random.seed(2)
    for _ in range(300):
        places = sorted(random.sample(range(14), random.randint(3, 7)))
        costs = [random.randint(1, 9) for _ in places]
        able = [c for c in combinations(range(len(places)), 2) if places[c[1]] - places[c[0]] >= 2]
        got = spelling.choose_pivots(places, costs, 2, 2)
        assert tuple(got) in able and sum(costs[i] for i in got) == min(sum(costs[i] for i in c) for c in able)


def test_chain_of_forms_ends_at_its_root(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(18)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(chain).collect()} == {f"w{i}": "w18" for i in range(18)}
