"""Readers on literal files."""

import pytest

from millrace import session
from millrace.operators import betting
from millrace.sources import files, kafka


def test_car_counts_by_glob(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2016-03-23T18:15,57A,23\n")
    (tmp_path / "b.txt").write_text("x,y,1\n")
    rows = files.car_counts(spark, str(tmp_path), "*.csv").collect()
    assert [(str(r.time), r.location, r["count"]) for r in rows] == [("2016-03-23 18:15:00", "57A", 23)]


def test_lines_of_every_file(spark, tmp_path):
    (tmp_path / "a").write_text("one\ntwo\n")
    (tmp_path / "b").write_text("three")
    assert sorted(r.value for r in files.lines(spark, str(tmp_path)).collect()) == ["one", "three", "two"]


def test_tumour_rows_skip_the_header_and_lose_quotes(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,diagnosis," + ",".join(f"f{i}" for i in range(30)) + "\n862485,\"B\"," + ",".join(str(i + 0.5) for i in range(30)) + "\n")
    row = files.tumours(spark, str(path)).first()
    assert (row.id, row.diagnosis, row.radius_mean, row.fractal_dimension_worst) == (862485, "B", 0.5, 29.5)


def test_last_event_of_a_name_wins(spark, tmp_path):
    line = '{"id":%d,"name":"%s","races":[{"id":1,"hasRun":true,"winner":{"name":"H%d","id":%d}}]}'
    (tmp_path / "races.json").write_text("\n".join(line % (i, "same" if i < 3 else "other", i, i) for i in range(4)))
    winners = betting.event_winners(files.events(spark, str(tmp_path)))
    assert {r.event: r.winner for r in winners.collect()} == {"same": 2, "other": 3}


def test_dictionary_codes_move_up(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"movie": 14,\n "the": 1}')
    assert {r.word: r.code for r in files.word_index(spark, str(tmp_path / "index.json")).collect()} == {"movie": 17, "the": 4}


def test_sample_reviews_and_images(spark, tmp_path):
    assert {r.key: r.text for r in files.sample_reviews(spark).collect()}[0] == "a fine evening, well played"
    (tmp_path / "x.png").write_bytes(b"\x89PNG")
    assert files.images(spark, str(tmp_path), "*.png").first().content == b"\x89PNG"


def test_topic_records_become_texts(spark):
    records = spark.createDataFrame([(bytearray(b"Palladium"), bytearray(b"0.91"), 1, 10)], "key binary, value binary, partition int, offset long")
    assert tuple(kafka.key_values(records).first()) == ("Palladium", "0.91", 1, 10)


def test_checkpoint_folder_is_the_one_the_session_names(spark):
    assert session.scratch_path(spark, "x").startswith(session.checkpoint_dir(spark).rstrip("/"))
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.checkpoint_dir(spark) == named


def test_attached_file_is_found_by_tasks(spark, tmp_path):
    from pyspark import SparkFiles
    from millrace.operators.scoring import attach
    (tmp_path / "model.txt").write_text("weights")
    name = attach(spark, str(tmp_path / "model.txt"))
    assert open(SparkFiles.get(name)).read() == "weights"
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "index.json").write_text("{}")
    folder = attach(spark, str(tmp_path / "folder"), folder=True)
    assert open(SparkFiles.get(folder) + "/index.json").read() == "{}"


def test_cluster_without_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
