"""Records of all shards are read in a seeded order by way of their indexes."""

import public_tokenizers

from emberglass.llm import files, records
from emberglass.storage import Scratch


def test_shuffled_reads_give_every_record_once(spark):
    scratch = Scratch(spark, "t")
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 7)) for k in range(200)] + [(None, None)], "doc_id long, text string")
    manifest = scratch.save(records.write_records(docs, scratch.path("r"), public_tokenizers.path("word_bpe_49k.json"), 1, per_shard=30))
    plain = sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in records.read_records(manifest).collect())
    orders = []
    for seed in (0, 0, 1):
        got = records.read_shuffled(manifest, seed, 2).collect()
        assert sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in got) == plain
        orders.append([r["doc_id"] for r in got])
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0], key=lambda i: -1 if i is None else i)
    assert records.read_shuffled(manifest.filter("false")).count() == 0


def test_names_of_object_stores():
    assert files.filesystem("file:///tmp/x")[1] == "/tmp/x"
