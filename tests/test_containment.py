"""Containment join against ``in`` on all pairs."""
import random

from pyspark.sql import functions as F

from dunning.operators.containment import containing, first_containing
from dunning.streaming import webhook as W


def _pairs(spark, texts, patterns, **kw):
    t = spark.createDataFrame([(x, 1) for x in texts], "text string, gram int")
    p = spark.createDataFrame([(x, 1) for x in patterns], "pattern string, key int")
    return sorted(map(tuple, containing(t, p, **kw).collect()))


def test_containment_equals_in_on_all_pairs(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(40))) for _ in range(120)] + [None, "", "plink_ab", "x plink_abc;y", "plink_abc"]
    patterns = ["".join(rng.choice("abé ") for _ in range(rng.randrange(14))) for _ in range(60)] + [None, "", "plink_ab", "plink_abc", "plink_", "nowhere", "p"]
    want = sorted((p, t) for p in {x for x in patterns if x} for t in {x for x in texts if x is not None} if p in t)
    for gram in (1, 3, 8):
        assert _pairs(spark, texts, patterns, gram=gram) == want
    assert _pairs(spark, texts, []) == [] and _pairs(spark, [], patterns) == []


def test_common_prefix_is_not_the_anchor(spark):
    notes = [f"payment_link_id=plink_{k:014d}; amount=1.00" for k in range(500)]
    t = spark.createDataFrame([(x,) for x in notes], "text string")
    p = spark.createDataFrame([(f"plink_{k:014d}",) for k in range(0, 1000, 5)], "pattern string")
    got = containing(t, p)
    assert got.count() == 100 and got.where(~F.contains("text", "pattern")).count() == 0


def test_first_row_in_order_wins_and_hot_notes_are_one_text(spark):
    rows = [("2", "sent plink_a and plink_b", "p2"), ("1", "retry of plink_a", "p1"), ("3", "plink_b", "p3")] + [("0", "none", f"h{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "execution_timestamp string, notes string, payment_id string")
    p = spark.createDataFrame([("plink_a",), ("plink_b",), ("plink_c",), (None,)], "pattern string")
    got = {r["pattern"]: r["row"]["payment_id"] for r in first_containing(df, "notes", ["execution_timestamp", "notes"], p).collect()}
    assert got == {"plink_a": "p1", "plink_b": "p2"}


def test_match_finds_ids_in_any_note(spark):
    rec = spark.createDataFrame([("e1", "plink_a"), ("e2", "plink_x"), ("e3", None)], "event_id string, payment_link_id string")
    att = spark.createDataFrame([("2024", "manual: see plink_a (mail)", "a", "sent", "p1"), ("2023", "plink_ab", "a", "sent", "p2")],
                                "execution_timestamp string, notes string, action_taken string, execution_status string, payment_id string")
    got = {r.event_id: (r.matched, r.matched_payment_id) for r in W.match_by_containment(rec, att).collect()}
    assert got == {"e1": (True, "p2"), "e2": (False, None), "e3": (False, None)}  # the earlier note wins, though its id only contains the link
