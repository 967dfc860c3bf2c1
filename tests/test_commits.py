"""Runs that are interrupted, batches that are damaged, and releases that fail half-way."""

from __future__ import annotations

import json

import pytest
from fixtures import REFERENCE, margins, rows
from pyspark.sql import functions as F

from marginloom import schemas
from marginloom.operators.gates import Gates, QualityError
from marginloom.plans import audit, publication, releases, run
from marginloom.session import materialize
from marginloom.sources import commits


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    root, m = str(tmp_path_factory.mktemp("runs")), margins(spark)
    whole = run.run(spark, m, REFERENCE, f"{root}/whole", fixture=True)
    first = run.run(spark, m, REFERENCE, f"{root}/parts", provinces=["980"], fixture=True)
    assert {r.province for r in first.persons.collect()} == {"980"}
    again = run.run(spark, m, REFERENCE, f"{root}/parts", fixture=True)
    return m, whole, again


def test_an_interrupted_run_ends_alike(spark, finished):
    m, whole, again = finished
    for name in ("individuals", "persons", "households"):
        assert rows(getattr(whole, name)) == rows(getattr(again, name))
    done = run.completed(spark, again.path)
    assert done.count() == done.select("province", "table").distinct().count() == 6
    third = run.run(spark, m, REFERENCE, again.path.rsplit("/", 1)[0], fixture=True)
    assert third.run_id == again.run_id and run.completed(spark, again.path).count() == 6
    assert all(c.passed for c in run.verify(spark, again.path, m, REFERENCE))


def test_publication_is_whole_or_absent(spark, finished, tmp_path, monkeypatch):
    m, whole, again = finished
    root, options = str(tmp_path), dict(is_fixture=True, allow_fixture=True)
    first = publication.publish_population(spark, root, whole, m, REFERENCE, "2024-12-31", **options)
    people = rows(publication.population_table(spark, root, first, "population_persons"))
    # Replayed from the other folder: the same run, so nothing is written.
    assert publication.publish_population(spark, root, again, m, REFERENCE, "2024-12-31", **options) == first
    assert commits.commits(spark, root).count() == 1 and commits.abandoned(spark, root) == []
    with pytest.raises(ValueError):
        publication.publish_population(spark, root, whole, m, REFERENCE, "2024-12-31", is_fixture=True)

    def stop(*_):
        raise OSError("lost")

    other = run.Run("other", whole.path, whole.individuals, whole.persons, whole.households)
    monkeypatch.setattr(commits, "table_manifest", stop)  # after the tables, before the commit
    with pytest.raises(OSError):
        publication.publish_population(spark, root, other, m, REFERENCE, "2024-12-31", **options)
    monkeypatch.undo()
    assert len(commits.abandoned(spark, root)) == 1 and commits.commits(spark, root).count() == 1
    assert rows(publication.population_table(spark, root, first, "population_persons")) == people
    with pytest.raises(ValueError):
        publication.population_table(spark, root, "population-other-2", "population_persons")
    second = publication.publish_population(spark, root, other, m, REFERENCE, "2024-12-31", **options)
    assert second == "population-other-2"
    record = publication.population_table(spark, root, second, "population_snapshots").first()
    assert (record.id, record.persons) == (2, whole.persons.count())


def test_a_changed_run_is_refused(spark, finished, tmp_path):
    m, whole, _ = finished
    options = dict(is_fixture=True, allow_fixture=True)
    publication.publish_population(spark, str(tmp_path), whole, m, REFERENCE, "2024-12-31", **options)
    changed = run.Run(whole.run_id, whole.path, whole.individuals, whole.persons.limit(5), whole.households)
    with pytest.raises(QualityError):
        publication.publish_population(spark, str(tmp_path), changed, m, REFERENCE, "2024-12-31", **options)


def test_failed_gates_commit_nothing(spark, tmp_path):
    frame = spark.range(5).withColumnRenamed("id", "release_id").select(F.col("release_id").cast("string"))

    def bad(stored):
        return Gates().empty("never", stored["t"])

    with pytest.raises(QualityError):
        commits.commit_release(spark, str(tmp_path), "r", "s", {"t": frame}, {"t": ["release_id"]}, bad)
    assert commits.commits(spark, str(tmp_path)).count() == 0
    assert spark.read.json(f"{tmp_path}/quarantine").first().check_name == "never"
    commits.commit_release(spark, str(tmp_path), "r", "s", {"t": frame})
    assert commits.read_table(spark, str(tmp_path), "r", "t", frame.schema).count() == 5
    with pytest.raises(QualityError):
        commits.commit_release(spark, str(tmp_path), "r", "another source", {"t": frame})


def test_a_damaged_batch_is_named(spark, finished):
    m, _, again = finished
    kept = materialize(again.persons.filter("province = '970' and person_id <> 4").drop("province"), "kept")
    kept.write.mode("overwrite").parquet(f"{again.path}/persons/province=970")
    found = run.damaged_batches(spark, again.path)
    assert [(r.province, r["table"], r["rows"] - r.found_rows) for r in found.collect()] == [("970", "persons", 1)]
    with pytest.raises(QualityError) as error:
        run.verify(spark, again.path, m, REFERENCE)
    assert "batches" in {c.name for c in error.value.checks if not c.passed}


def test_gates_of_a_publication_run_once_on_what_was_written(spark, finished, tmp_path, monkeypatch):
    """Checks in the snapshot are those of the stored tables, and the report is the run's own."""
    m, result, _ = finished
    read, gates, summary = [], publication.publish.publication_gates, audit.summary

    def seen(persons, *rest):
        read.append(persons.inputFiles())
        return gates(persons, *rest)

    monkeypatch.setattr(publication.publish, "publication_gates", seen)
    root = f"{tmp_path}/published"
    release = publication.publish_population(spark, root, result, m, REFERENCE, "2024-12-31", is_fixture=True, allow_fixture=True)
    assert len(read) == 1 and all("/published/" in f for f in read[0])
    record = publication.population_table(spark, root, release, "population_snapshots").first()
    assert len(json.loads(record.publication_checks)) == 7 and json.loads(record.report)["persons"] == 60
    rows = releases.table_manifest({"persons": result.persons, "households": result.households})
    monkeypatch.setattr(publication.audit, "summary", lambda *a, **b: summary(*a, **b).filter("false"))
    kept = publication.run_report(result, publication.source_digest(rows), m, REFERENCE)
    assert kept.collect() == audit.profile_summary(audit.person_profile(result.persons, m, REFERENCE), result.households, m).collect()
