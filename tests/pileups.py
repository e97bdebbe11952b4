"""Small pileups from spec strings."""

GROUPS = "group_id bigint, construct_id bigint, group_ord int, name string, ref_seq string, ref_start int, n_reads bigint, fraction double, status string, highlighted boolean, parent string"
ROWS = "row_id bigint, group_id bigint, read_ord bigint, spec string, seen_at timestamp_ntz, loaded_at timestamp_ntz"


def groups(spark, *refs, parents=()):
    data = [(i + 1, 1, i, f"g{i}", r, 0, 10, 1.0, "match", False, parents[i] if i < len(parents) else "") for i, r in enumerate(refs)]
    return spark.createDataFrame(data, GROUPS)


def rows(spark, specs, group=1, start=0):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    return spark.createDataFrame([(start + i, group, i, s, t + timedelta(seconds=i), t) for i, s in enumerate(specs)], ROWS)
