import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import manifest as mf

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ORDER = ("doc_id", "source", "lang", "n_chars", "text")


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """The root, and for each node what stands before and behind it on the way up."""
    paths, above = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for m in above[k]:
                    paths[m].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        above = [[m for k in run for m in above[k]] for run in runs]
        nodes = [H("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in by[g]], fanout)
    root, tops = tree([trees[g][0] for g in langs], fanout)
    out = []
    for g, top in zip(langs, tops, strict=True):
        subroot, paths = trees[g]
        for r, path in zip(by[g], paths, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for a, b in path + top:
                h = H(a + h + b)
            assert changed or h == root
            out.append((r[0], leaf(r), subroot, root, H("".join(a + b for a, b in path + top)), h, not changed))
    return out


def got(df, **kw):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = mf.dataset_manifest(df, tampered=("n_chars", changed, F.col("n_chars").cast("decimal(20,0)") + 1), **kw)
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()]


def check(spark, rows, **kw):
    want = brute(rows, kw.get("fanout", mf.FANOUT))
    found = got(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    assert sorted(found, key=repr) == sorted(want, key=repr)
    return want


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i if rng.random() > 0.02 else None, rng.choice(["a", "é", None]), rng.choice(langs), rng.choice([None, i]), rng.choice(["", None, f"text {i}"])) for i in range(n)]
    return rows + [(None, None, None, None, None)] * 2 + [rows[0]] * 3 + [(7, "b", langs[0], 1, "x")] * 2


def test_blocks_and_rounds(spark):
    """Groups of many blocks, of one block and of one row; the last subtree of a round has fewer blocks."""
    check(spark, rows_of(75, ["en", "en", "en", "de", "fr", None]) + [(1, "s", "zz", 1, "one row")], leaves=4)


def test_hot_group_and_other_fanout(spark):
    check(spark, rows_of(120, ["en"] * 9 + ["de"]), leaves=9, fanout=3)


def test_many_groups(spark):
    """More groups than a block has leaves: their roots are exchanged as well."""
    check(spark, [(i, None, f"g{i % 23}", i, "t") for i in range(60)] + [(1, None, "G", None, ""), (2, None, "é", None, "")], leaves=2)


def test_one_block(spark):
    assert len(check(spark, rows_of(40, ["en", "de"]))) == 47


def test_edges(spark):
    check(spark, [(1, None, None, 2**63 - 1, "x" * 100_000), (0, "s", "en", 5, "")])
    only = check(spark, [(3, "s", "en", 5, "alone")])
    assert only[0][1] == only[0][2] == only[0][3] and only[0][4] == H("")
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_clashing_columns(spark):
    rows = rows_of(30, ["en", None])
    df = spark.createDataFrame([(*r, "k", 1, "l") for r in rows], SCHEMA + ", key string, block int, leaf string")
    assert sorted(got(df, leaves=8), key=repr) == sorted(brute(rows, 2), key=repr)
