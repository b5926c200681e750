"""What a task of the corpus pipeline holds at once."""

import io
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from nodeloom.llm import _shingles, bpe, language_id, ngram_join


def texts(size=8 << 20, each=4000, seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    return [" ".join(rnd.choices(words, k=each // 6)) for _ in range(size // each)]


def peak(task):
    """MB that task holds beyond what was there, and what it leaves in the worker."""
    tracemalloc.start()
    try:
        task()
        left, most = tracemalloc.get_traced_memory()
        return most / 1e6, left / 1e6
    finally:
        tracemalloc.stop()


def test_words_are_hashed_in_slices_that_leave_little_behind(monkeypatch):
    some, cut = texts(2 << 20), []
    monkeypatch.setattr(_shingles, "_powers", {})
    data = np.frombuffer(" ".join(some).encode(), np.uint8)
    most, left = peak(lambda: cut.append(_shingles.word_hashes(data)))
    assert most < 40 and left < 15  # words' hashes and starts are 16 bytes a word, the powers of a slice 4 MB
    monkeypatch.setattr(_shingles, "_SLICE", 1 << 30)
    whole = _shingles.word_hashes(data)
    assert all(np.array_equal(a, b) for a, b in zip(cut[0], whole))


def test_languages_are_told_in_chunks(monkeypatch):
    some = texts(3 << 20)
    rnd = np.random.default_rng(3)
    model = language_id.LanguageFilter(["a", "b"], {k: rnd.integers(0, 2**63, 4000).astype(np.uint64) for k in "ab"})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], names=["i", "x"])
    language_id._letters()

    def told():
        names, score = [], []
        for _, part, _ in language_id.chunks(iter([batch]), 1):
            n, s = model.predict(part)
            names += n
            score += s.tolist()
        return names, score

    found = []
    assert peak(lambda: found.append(told()))[0] < 40
    monkeypatch.setattr(language_id, "CHUNK", 1 << 30)
    assert found[0] == told()


class Task:
    """In place of Spark's context of a task."""

    @staticmethod
    def get():
        return Task

    @staticmethod
    def partitionId():
        return 3


def arriving(some, each=500):
    """Batches of (number, text), each in memory of its own, as from a stream."""
    rows = pa.table({"i": pa.array(range(len(some)), pa.int64()), "x": some}).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(pa.RecordBatch.from_pylist([], rows.schema))
        for batch in rows.to_batches(max_chunksize=each):
            out.write_batch(batch)
    return pa.ipc.open_stream(io.BytesIO(sink.getvalue()))


def test_a_batch_of_texts_is_hashed_in_slices(monkeypatch):
    some = texts(8 << 20)
    monkeypatch.setattr(ngram_join, "TaskContext", Task)

    def pieces(full):
        return list(ngram_join._pieces(40, 5, full)(arriving(some)))

    for full in (False, True):
        cut = []
        assert peak(lambda: cut.extend(pieces(full)))[0] < 110
        monkeypatch.setattr(ngram_join, "SLICE_BYTES", 1 << 30)
        assert cut == pieces(full)
        monkeypatch.undo()
        monkeypatch.setattr(ngram_join, "TaskContext", Task)


def test_splitting_holds_neither_earlier_batches_nor_the_tokenizer(monkeypatch):
    some = texts(12 << 20)
    monkeypatch.setattr(bpe, "TaskContext", Task)
    bpe.vocabulary.cache_clear()
    task = bpe._split({"<|endoftext|>": 0}, 20)
    made, given = [], arriving(some)
    assert peak(lambda: made.extend(b.num_rows for b in task(given)))[0] < 40
    assert sum(made) == len(some) + 20
    assert bpe.vocabulary.cache_info().currsize == 0


def test_a_text_goes_through_the_language_stage_once(spark, monkeypatch):
    import corpus_pipeline

    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 9, ("en", "de")[k % 2 == 0], "s", k) for k in range(40)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n int")
    given, identify = [], language_id.identify
    monkeypatch.setattr(language_id, "identify", lambda d, *a, **b: given.append(d) or identify(d, *a, **b))
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert given[0].schema.simpleString().count("text:") == 1
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(rows)
