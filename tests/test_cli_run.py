import json

from fieldlead import cli, pipeline


def test_shuffle_partitions_reach_the_session(spark, tmp_path, monkeypatch):
    key, seen = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    monkeypatch.setattr(pipeline, "run", lambda *_: seen.append(spark.conf.get(key)))
    for name in ("documents", "listings", "codes"):
        spark.range(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "c.json").write_text(json.dumps({"runtime": {"shuffle_partitions": 3}}))
    try:
        assert cli.main(["run", "--config", str(tmp_path / "c.json"), "--data", str(tmp_path), "--out", str(tmp_path / "out")]) == 0
    finally:
        spark.conf.set(key, before)
    assert seen == ["3"]
