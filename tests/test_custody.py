import hashlib

import pytest
from pyspark.sql import functions as F

from tallyline.plans import custody


def sha(b):
    return hashlib.sha256(b).hexdigest()


def root(hashes):
    if not hashes:
        return sha(b"")
    while len(hashes) > 1:
        hashes = [sha(bytes.fromhex(a) + bytes.fromhex(b)) for a, b in zip(hashes[::2], [*hashes[1::2], hashes[-1]])]
    return hashes[0]


def table(spark, rows):
    return spark.createDataFrame([(i, sha(v.encode())) for i, v in rows], "id string, row_hash string")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50])
def test_root_and_proofs(spark, n):
    files, log = [(f"{k:03}", f"f{k}") for k in range(n)], [(f"{k:03}", f"f{k}") for k in range(n // 2)]
    tables = {"audit_log": table(spark, log[::-1]), "files": table(spark, files[::-1])}
    first = custody.anchor(tables)
    plain = [sha(f"files:{sha(v.encode())}".encode()) for _, v in files] + [sha(f"audit_log:{sha(v.encode())}".encode()) for _, v in log]
    assert first.root == root(plain) and first.leaf_count == len(plain)
    second = custody.anchor(tables, first.root)
    assert second.root == root([sha(f"previous_root:{first.root}".encode()), *plain]) and second.row_counts == {k: v for k, v in (("files", n), ("audit_log", n // 2)) if v}
    assert custody.follows(second, first) and not custody.follows(second, second)
    if n == 7:
        rows = spark.createDataFrame([("files", f"{k:03}") for k in range(n)] + [("audit_log", "001"), ("files", "none")], "source string, id string")
        found = custody.proofs(second, rows).withColumn("root", custody.folded(F.col("h"), F.col("path"))).collect()
        assert len(found) == n + 1 and {r.root for r in found} == {second.root}
        changed = {"audit_log": tables["audit_log"], "files": table(spark, [*files[1:], ("000", "other"), ("9", "new")])}
        assert [tuple(r) for r in custody.missing(first, changed).collect()] == [("files", "000")]
