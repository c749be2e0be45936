"""Token files encode each text once: ids are stored, counted and written from there."""

from dumpweave.llm import token_files
from dumpweave.llm.queries import tokenizer_file


def test_only_one_python_step_reads_texts(spark, odd, monkeypatch):
    read = []

    def spy(df, function, ddl):
        read.append("text" in df.columns)
        return map_partition(df, function, ddl)

    map_partition = token_files.map_partition
    monkeypatch.setattr(token_files, "map_partition", spy)
    found = token_files.token_files(odd, tokenizer_file("byte_bpe_50k.json")).collect()
    assert len(found) == odd.count()
    assert sum(read) == 1


def test_ids_of_four_bytes(spark):
    # an end id beyond two bytes
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    few = token_files.token_files(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    many = token_files.token_files(docs, tokenizer_file("byte_bpe_50k.json"), end_id=70_000)
    shape = [[(r["doc_id"], r["start"], r["n_tokens"]) for r in x.orderBy("doc_id").collect()] for x in (few, many)]
    assert shape[0] == shape[1]
