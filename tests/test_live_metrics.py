"""AGG-6 kept up to date over a stream equals the batch document after every micro-batch."""
import os
import random
import tempfile

from dunning.operators import metrics
from dunning.streaming import live_metrics as LM

ACTIONS = ["retry_now", "retry_later", "send_reminder", "escalate_human", None]


def _truth(spark, feed):
    """The batch document of the rows that count after ``feed``."""
    best, nameless = {}, []
    for kind, pid, version, deleted, *content in feed:
        if pid is None:
            nameless += [] if deleted else [(kind, *content)]
        elif (kind, pid) not in best or version > best[kind, pid][0]:
            best[kind, pid] = (version, deleted, content)
    rows = nameless + [(k[0], *v[2]) for k, v in best.items() if not v[1]]
    df = spark.createDataFrame(rows, "kind string, action string, outcome string, amount string, recovered_amount string")
    df = df.withColumns({c: df[c].cast("decimal(18,2)") for c in ("amount", "recovered_amount")})
    return metrics.final_metrics(df.where("kind = 'decision'"), df.where("kind = 'outcome'")).first()


def test_document_follows_replacements_and_withdrawals(spark):
    rng, base = random.Random(11), tempfile.mkdtemp(prefix="dunning-live-")
    feed, version = [], 0
    assert LM.document(spark, f"{base}/counts") is None
    for step in range(3):
        rows = []
        for _ in range(40):
            version += 1
            pid = rng.choice([None, *(f"p{k}" for k in range(12))])
            if rng.random() < 0.5:
                rows.append(("decision", pid, version, rng.random() < 0.2, rng.choice(ACTIONS), None, None, None))
            else:
                paid = rng.random() < 0.5
                amount = f"{rng.randrange(10 ** 7)}.{rng.randrange(100):02d}"
                rows.append(("outcome", pid, version, rng.random() < 0.2, "retry_now", "recovered" if paid else "failed", amount,
                             amount if paid else "0.00"))
        late = [r for r in feed if r[1] is not None][:5]  # repeated rows of old versions change nothing
        feed += rows
        rng.shuffle(rows)
        spark.createDataFrame(rows + late, LM.CHANGE_SCHEMA).repartition(3).write.mode("append").parquet(f"{base}/feed")
        LM.start(spark, f"{base}/feed", f"{base}/counts", f"{base}/ckpt").awaitTermination()  # each step restarts the query
        assert LM.document(spark, f"{base}/counts").first() == _truth(spark, feed)
    # an epoch tried again publishes the same row in place of the old one
    before = LM.document(spark, f"{base}/counts").first()
    last = sorted(os.listdir(f"{base}/ckpt/commits"))
    newest = max(int(n) for n in last if n.isdigit())
    for name in (f"{newest}", f".{newest}.crc"):
        if os.path.exists(f"{base}/ckpt/commits/{name}"):
            os.remove(f"{base}/ckpt/commits/{name}")
    LM.start(spark, f"{base}/feed", f"{base}/counts", f"{base}/ckpt").awaitTermination()
    assert LM.document(spark, f"{base}/counts").first() == before


def test_state_is_one_value_a_bucket(spark):
    base = tempfile.mkdtemp(prefix="dunning-live-buckets-")
    rows = [("decision", f"p{k}", 1, False, "retry_now", None, None, None) for k in range(500)]
    spark.createDataFrame(rows, LM.CHANGE_SCHEMA).write.parquet(f"{base}/feed")
    signed = LM.signed_rows(spark.readStream.schema(LM.CHANGE_SCHEMA).parquet(f"{base}/feed"), buckets=5)
    query = (signed.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == 500
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) == 5
