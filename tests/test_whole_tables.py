"""Queries take their whole tables."""

from emberglass.plans import catalogue


def test_dbscan_takes_all_suppliers(spark, tmp_path):
    spark.range(1, 1301).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["id"]: (r["kind"], r["label"]) for r in catalogue.queries()["dbscan_labels"](spark, str(tmp_path)).collect()}
    at = {s: (s * 37 % 101, s * 53 % 103) for s in range(1, 1301)}
    near = {s: [o for o in at if o != s and (at[s][0] - at[o][0]) ** 2 + (at[s][1] - at[o][1]) ** 2 <= 100] for s in at}
    core = {s for s in at if len(near[s]) + 1 >= 4}
    label = {}
    for s in sorted(core):
        todo = [s] if s not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = s
                todo += [o for o in near[x] if o in core]
    border = {s: min((label[o] for o in near[s] if o in core), default=None) for s in at}
    assert got == {s: ("core", label[s]) if s in core else ("border", border[s]) if border[s] else ("noise", -1) for s in at}
