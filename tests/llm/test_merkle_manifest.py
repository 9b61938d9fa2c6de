import hashlib
import random
import re
import zlib

import pytest

from sluicework.llm import merkle_manifest as M

from .helpers import documents, empty, with_clashes


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), r.text) if lower and r.text is not None else r.text
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def proofs(leaves):
    """The root, and for each leaf its siblings (before, after) level by level."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for p, i in zip(paths, at):
            a = i - i % 16
            p.append(("".join(leaves[a:i]), "".join(leaves[i + 1 : a + 16])))
        at = [i // 16 for i in at]
        leaves = [H(*leaves[i : i + 16]) for i in range(0, len(leaves), 16)]
    return leaves[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault((r.source is not None, (r.source or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), r))
    trees = [sorted(by[k], key=lambda x: x[:3]) for k in sorted(by)]
    roots = [proofs([x[2] for x in t]) for t in trees]
    root, upper = proofs([r for r, _ in roots])
    out = []
    for t, (subroot, paths), above in zip(trees, roots, upper):
        for (_, _, own, r), path in zip(t, paths):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            x = leaf(r, changed)
            for b, a in path + above:
                x = H(b, x, a)
            out.append((r.doc_id, own, subroot, root, H(*[b + a for b, a in path + above]), x, x == root))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=repr)


def run(docs, tmp_path, spark):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return M.op11_merkle_manifest(spark, str(tmp_path))


def test_awkward_rows_have_the_manifest_of_a_plain_build(spark, tmp_path):
    docs = documents(spark)
    assert got(run(docs, tmp_path, spark)) == plain(docs.collect())
    assert got(run(with_clashes(docs), tmp_path, spark)) == plain(docs.collect())
    one = docs.where("doc_id = 9")
    assert got(run(one, tmp_path, spark)) == plain(one.collect())


def test_an_empty_table_has_no_rows(spark, tmp_path):
    assert run(empty(spark), tmp_path, spark).collect() == []


@pytest.mark.parametrize("levels", [1, 3])
def test_trees_of_many_tiers(spark, tmp_path, levels, monkeypatch):
    """Blocks of 16 leaves alone, so that six tiers are needed, and of 4096."""
    monkeypatch.setattr(M, "LEVELS", levels)
    rng = random.Random(5)
    rows = [(i, f"Text {rng.random()}" if i % 9 else None, "en", None if i % 31 == 0 else f"s{i % 7 and i % 40}é", i) for i in rng.sample(range(10**9), 5000)]
    rows += [(10**12 + i, f"X{i}", "de", "hot", i) for i in range(4500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(run(docs, tmp_path, spark)) == plain(docs.collect())


def test_a_version_has_only_the_nodes_above_its_leaf(spark):
    rows = [(i, f"Text {i}", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    out = M.manifest(docs, "source", "doc_id", ["doc_id", "text"], {"text": F.lower("text")}, F.col("doc_id") % 10 == 0, with_nodes=True).collect()
    assert len(out) == 300
    for r in out:
        assert (r.copied is not None) == (r.doc_id % 10 == 0) == (not r.verified)
        if r.copied:
            assert len(r.copied) == len(r.siblings) == 3 and r.copied[-1] == r.folded_root != r.root
