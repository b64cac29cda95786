import zlib

import zstandard

from tallyforge.llm import language

WORDS = {"en": "the quick of and with house from that river stone", "fr": "les avec pour dans une maison rouge était où très", "de": "der und nicht mit eine haus über schön straße weil"}


def texts(lang, n):
    w = WORDS[lang].split()
    return " ".join(w[(i * 7 + n * 3 + i // 5) % len(w)] for i in range(80))


def test_languages(spark, docs):
    rows = [(i, texts(lang, i), lang) for i, lang in enumerate(sorted(WORDS) * 20)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !!", "en"), (903, texts("fr", 1) * 300, None), (903, texts("fr", 1) * 300, None)]
    frame = docs([*rows, *odd]).withColumnRenamed("source", "score")
    from pyspark.sql import functions as F

    model = language.fit(frame, language.learnable(F.col("doc_id")))
    out, (lang, score, rejected) = language.classify(frame, model)
    assert out.columns[: len(frame.columns)] == frame.columns and score == "_score"
    got = {r["doc_id"]: r for r in out.collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(got[i][lang] == want for i, _, want in held)
    assert all(got[i][lang] == "und" and got[i][rejected] for i in (900, 901, 902))
    assert got[903][lang] == "fr" and not got[903][rejected]
    assert all(0 <= r[score] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in language.accepted(docs([*rows, *odd])).collect()}
    assert kept == {r[0] for r in rows} | {903}


def test_nothing_to_learn_from(spark, docs):
    out, names = language.classify(docs([(1, "some words")]), [])
    assert [tuple(r[n] for n in names) for r in out.collect()] == [("und", 0.0, True)]
    assert language.accepted(docs([])).count() == 0


def test_repeats_count():
    """A German text of one line again and again, with a shorter English passage of other words."""
    model = [(lang, " ".join(texts(lang, i) for i in range(20)).encode()) for lang in ("en", "de")]
    judge = language.Judge(model)
    line = "Der Hund und die Katze schlafen nicht mit dem Vogel unter einem alten Baum"
    passage = "The quick of and with house from that river stone " + " ".join(f"{a}{b}" for a in ("river", "stone", "house", "quick") for b in ("from", "with", "that", "and", "the"))
    assert judge(line)[0] == "de" and judge(passage)[0] == "en"
    sizes = judge.sizes(line + ("\n" + line) * 399 + "\n" + passage)
    assert sizes[1] < sizes[0]
    assert judge.sizes("\n".join([line] * 400))[0] > 5 * judge.sizes(line)[0]


def test_choice_equals_plain_loops(spark, tables):
    """Sizes under each language's dictionary, the choice and the score, recomputed text by text."""
    from pyspark.sql import functions as F

    frame = spark.read.parquet(f"{tables}/documents.parquet")
    model = language.fit(frame, language.learnable(F.col("doc_id")))
    assert all(0 < len(content) <= language.DICT_BYTES for _, content in model)
    got = {r["doc_id"]: r for r in language.op2_language_id(spark, tables).collect()}
    rows = frame.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        raw, sizes = r["text"].lower().encode(), []
        for _, content in model:
            total = 0
            for i in range(0, len(raw), language.BLOCK):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=language.LEVEL)
                total += len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(raw[i : i + language.BLOCK]))
            sizes.append(total)
        best = sizes.index(min(sizes))
        assert got[r["doc_id"]]["lang_pred"] == model[best][0]
        assert abs(got[r["doc_id"]]["score"] - 1 / sum(2 ** max(-60.0, (min(sizes) - s) / 2) for s in sizes)) < 1e-12
