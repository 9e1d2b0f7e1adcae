"""Archives are planned by member: tasks, filters, conventions, errors."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from rallyframe.sources import archives

HEAD = "﻿Frame,Visibility,X,Y,theta,l\n"


@pytest.fixture
def folder(tmp_path):
    for a in (1, 2):
        with zipfile.ZipFile(f"{tmp_path}/a{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("data/", "")
            z.writestr("data/readme.txt", "no rows")
            for rally in range(1, 21):
                z.writestr(f"data/{a}_csv_{rally}.csv", HEAD + "".join(f"{f},{f % 2},{f}.5,{'' if f % 2 == 0 else rally},0.1,\n" for f in range(50)))
            z.writestr(f"data/{a}_endpoint_csv_7.CSV", HEAD.lower() + "3,1,9,9,,\n")
    return tmp_path


def test_rows_and_tasks(spark, folder):
    rows = archives.annotations(spark, f"{folder}/*.zip", partition_bytes=1)
    assert rows.count() == 2 * 20 * 50 and rows.rdd.getNumPartitions() == 40
    assert archives.annotations(spark, str(folder)).rdd.getNumPartitions() == 2
    r = rows.where("match_id = 2 and rally_id = 3 and frame = 5").first()
    assert (r.x, r.y, r.theta, r.l, r.visibility, r.member) == (5.5, 3.0, 0.1, None, 1, "data/2_csv_3.csv") and r.archive.endswith("a2.zip")
    assert rows.agg(F.count("y"), F.count("l")).first() == (2 * 20 * 25, 0)


def test_keys_choose_members(spark, folder):
    for wanted, members in (({"matches": [2]}, 20), ({"matches": [2], "rallies": (3, 4)}, 2), ({"rallies": range(19, 21)}, 4), ({"member": "*_csv_5.csv"}, 2), ({"rallies": [99]}, 0), ({"matches": []}, 0)):
        got = archives.annotations(spark, str(folder), partition_bytes=1, **wanted)
        assert got.rdd.getNumPartitions() == max(members, 1), wanted
        assert got.select("match_id", "rally_id").distinct().count() == members, wanted
    every = archives.annotations(spark, str(folder))
    assert every.where("match_id = 2 and rally_id = 3").count() == 50 and every.count() == 2000
    assert every.where("match_id = 1").join(every.where("match_id = 2"), ["rally_id", "frame"]).count() == 1000


def test_conventions_and_columns(spark, folder):
    rows = archives.annotations(spark, f"{folder}/a1.zip", "endpoint", columns=("rally_id", "x"))
    assert [tuple(r) for r in rows.collect()] == [(7, 9.0)]
    with pytest.raises(Exception, match="convention"):
        archives.annotations(spark, f"{folder}/a1.zip", "other").collect()
    with pytest.raises(Exception, match="unknown columns"):
        archives.annotations(spark, f"{folder}/a1.zip", columns=("z",)).collect()
    with pytest.raises(Exception, match="no archive|a9.zip"):
        archives.annotations(spark, f"{folder}/a9*.zip").collect()


def test_the_last_member_of_a_key_counts_and_bad_rows_raise(spark, tmp_path):
    def written(name, *members):
        with zipfile.ZipFile(f"{tmp_path}/{name}.zip", "w") as z:
            for member, body in members:
                z.writestr(member, HEAD + body)
        return archives.annotations(spark, f"{tmp_path}/{name}.zip")

    assert [r.x for r in written("twice", ("a/1_csv_1.csv", "0,1,5,5,,\n"), ("b/01_csv_1.csv", "0,1,6,6,,\n")).collect()] == [6.0]
    assert written("empty", ("1_csv_1.csv", "")).count() == 0
    for name, body in (("frame", "x,1,1,1,,\n"), ("visibility", "1,2,1,1,,\n"), ("missing", "1,,1,1,,\n")):
        with pytest.raises(Exception, match="invalid annotation"):
            written(name, ("1_csv_1.csv", body)).collect()
    with pytest.raises(Exception, match="repeated frame 4"):
        written("repeated", ("1_csv_1.csv", "4,1,1,1,,\n4,1,2,2,,\n")).collect()


def test_a_long_member_comes_in_batches(spark, tmp_path):
    n = 3 * archives.BATCH_ROWS + 5
    with zipfile.ZipFile(f"{tmp_path}/long.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("4_csv_2.csv", HEAD + "".join(f"{f},0,,,,\n" for f in range(n)))
    assert archives.annotations(spark, f"{tmp_path}/long.zip").agg(F.count(F.lit(1)), F.max("frame")).first() == (n, n - 1)
