"""Mapped tables that are read more than once."""

from netloom.sources import tables as st


def test_trade_networks_are_a_written_table(spark):
    """Readers of the networks must not join orders and lines again: the table has few files, none of the inputs'."""
    nets = st.trade_networks(spark, "/root/testdata/sf0.001")
    assert nets.inputFiles() and not any("/root/testdata" in f for f in nets.inputFiles())


def test_tasks_grow_with_the_entries(spark, monkeypatch):
    """Counting and ranking deal their rows over as many tasks as the rows ask for, whatever their compressed size."""
    from netloom import storage
    from netloom.operators import scoring

    monkeypatch.setattr(storage, "TASK_ROWS", 300)
    entries = st.one_sample(spark, "/root/testdata/sf0.001")
    assert entries.rdd.getNumPartitions() >= 19  # about 6,000 lines
    kept = storage.materialize(entries, "entries")
    ranks = scoring.rank_genes_per_cell(kept, kept.select("gene").distinct().count())
    assert ranks.rdd.getNumPartitions() >= kept.count() // 300
