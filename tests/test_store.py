"""The store: a writer that dies, two writers, buckets that stay, keys of several columns, and uploads that are shared."""

import os
import tempfile

import pytest

from auditloom.operators import leads
from auditloom.sources.store import Conflict, Store


def frames(spark):
    lead = spark.createDataFrame([(i, f"n{i}") for i in range(40)] + [(None, "none")], "lead long, name string")
    mail = spark.createDataFrame([(i % 40, f"m{i}") for i in range(100)], "lead long, mail string")
    return lead, mail


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_dead_writer_changes_nothing(spark, monkeypatch):
    lead, mail = frames(spark)
    place = Store(spark, tempfile.mkdtemp(prefix="spark-"), "lead", 8)
    assert place.versions() == [] and place.commit({"leads": lead, "mails": mail}) == 1
    before = values(place.read("leads")), values(place.read("mails"))
    new = {"leads": lead.filter("lead < 3").selectExpr("lead", "'new' AS name"), "mails": mail.limit(0)}

    def dies(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            place.commit(new)
    assert place.versions() == [1] and (values(place.read("leads")), values(place.read("mails"))) == before
    assert place.commit(new) == 2
    assert {r[1] for r in values(place.read("leads")) if r[0] is not None and r[0] < 3} == {"new"}
    assert not [r for r in values(place.read("mails")) if r[0] in (0, 1, 2)]  # both tables, or none
    assert (values(place.read("leads", 1)), values(place.read("mails", 1))) == before
    assert place.vacuum(keep=1) > 0 and place.versions() == [2] and place.read("leads").count() == 41
    place.delete(spark.createDataFrame([(None,), (5,)], "lead long"))
    assert not [r for r in values(place.read("leads")) if r[0] in (None, 5)] and place.read("leads").count() == 39


def test_of_two_writers_the_second_fails(spark):
    lead, _ = frames(spark)
    root = tempfile.mkdtemp(prefix="spark-")
    one = Store(spark, root, "lead", 4)
    one.commit({"leads": lead})
    base = one._manifest()
    one.commit({"leads": lead.filter("lead = 1").selectExpr("lead", "'first' AS name")})
    two = Store(spark, root, "lead", 4)
    two._manifest = lambda version=None: base  # it has read before the other wrote
    with pytest.raises(Conflict):
        two.commit({"leads": lead.filter("lead = 1").selectExpr("lead", "'second' AS name")})
    assert [r for r in values(one.read("leads")) if r[0] == 1] == [(1, "first")]
    assert os.listdir(f"{root}/_versions") and not [n for n in os.listdir(f"{root}/_versions") if n.startswith("_")]


def test_only_touched_buckets_are_written(spark):
    lead, mail = frames(spark)
    place = Store(spark, tempfile.mkdtemp(prefix="spark-"), "lead", 16)
    place.commit({"leads": lead, "mails": mail})
    before = place._manifest()["tables"]
    place.commit({"leads": lead.filter("lead = 9").selectExpr("lead", "'x' AS name")})
    after = place._manifest()["tables"]
    changed = [b for b, f in after["leads"]["folders"].items() if before["leads"]["folders"].get(b) != f]
    assert len(changed) == 1 and after["mails"] == before["mails"]
    with pytest.raises(ValueError):
        place.commit({"leads": lead}, by=["name"])
    assert place.commit({"leads": lead.limit(0)}) == 3 and values(place.read("leads")) == values(place.read("leads", 2))


def test_drafts_are_regenerated_by_lead_and_channel(spark):
    rows = [(1, "email", "a", False), (1, "call", "b", False), (2, "email", "c", True), (2, "email", "d", False), (3, "email", "e", False)]
    place = Store(spark, tempfile.mkdtemp(prefix="spark-"), "lead", 4)
    place.commit({"drafts": spark.createDataFrame(rows, "lead long, channel string, text string, sent_manually boolean")})
    again = spark.createDataFrame([(1, "email", "A", False), (2, "email", "C", False), (4, "email", "F", False)], "lead long, channel string, text string, sent_manually boolean")
    new, keys = leads.regenerated(place.read("drafts"), again)
    place.commit({"drafts": new}, by=["lead", "channel"], keys=keys)
    assert sorted(r["text"] for r in place.read("drafts").collect()) == ["A", "F", "b", "c", "d", "e"]


def test_shared_uploads_stay(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"), (6, "c")], "job long, upload string")
    gone = spark.createDataFrame([(1,), (3,), (4,), (5,), (6,), (6,)], "job long")
    assert values(leads.uploads_to_remove(jobs, gone, "job", "upload")) == [("b",), ("c",)]
