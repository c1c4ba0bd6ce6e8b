"""Queries do the whole job: no row is left out by an id or a count."""

from ledgerlake import plans

SF = "/root/testdata/sf0.01"


def test_grid_validate_judges_every_order(spark):
    keys = [r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    assert max(keys) > 2000
    cell = lambda o: (o % 50 + 1 + (0.25 if o % 101 == 4 else 0), o % 11)
    fine = [cell(o) for o in keys if o % 101 not in (1, 2, 3)]
    repeated = {c for c in set(fine) if fine.count(c) > 1}
    want = []
    for o in keys:
        k = o % 101
        codes = [{1: "MISSING_VALUE", 2: "NONNUMERIC_VALUE", 3: "NONFINITE_VALUE"}[k]] if k in (1, 2, 3) else []
        codes += ["DUPLICATE_COORDINATE"] if k != 1 and cell(o) in repeated else []
        want.append((o, codes + (["GRID_COORDINATE_MISMATCH"] if k == 4 else [])))
    got = [(r["row"], r["reason_codes"]) for r in plans.queries()["grid_validate"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
