from orefield.llm import quality

PROSE = [
    "The batch reads every record of the ledger before the morning. It writes a report that the operators check each day.",
    "THE BATCH READS EVERY RECORD OF THE LEDGER. THE OPERATORS CHECK THE REPORT.", "> The batch reads each\n> record of the ledger and\n> writes it to the report file.", "the batch reads the ledger and the operators check the report while this job waits for that file",
    "Die Stapelläufe lesen die Sätze der Dateien, und unsere Leute prüfen diese Berichte.", "Les programmes lisent les fichiers de la nuit et nous vérifions ces rapports.", "Los programas leen los archivos de la noche y nuestros equipos revisan estos informes.",
    "Пакет читает все записи журнала и пишет отчёт для операторов каждое утро.", "      * The batch reads the ledger and writes the report.\n      * The operators check it each day.",
]
OTHER = [
    "- A.B.C\n- D.E.F\n- G.H.I", "NAME    QTY    AMT\n------  -----  -----\nX1      4      9.99", "       MOVE WS-A TO WS-B.\n       IF WS-B > 9\n           PERFORM 1000-X\n       END-IF.", "//J JOB (A),'X'\n//S EXEC PGM=P\n//D DD DSN=A.B,DISP=SHR", "CREATE TABLE A_B (\n A_ID INT NOT NULL,\n THE_B CHAR(3)\n);",
    "00000000  97 8D 50 39  j982\n00000010  F9 10 E0 1E  gLYl", "The job failed again.\n" * 12, "*****\n" * 9, "LEDGER batch COUNT rate HOLD item LIST order STEP node", "t h e b a t c h r e a d s a l e d g e r t h a t i s o l d", "™3KâÂE ¿a¿ nbÂ ¿the¿ 3A™ ƒÂZ", "The table:\n" + "1. A-B\n" * 3 + "\n".join(f"{i}. X{i}-Y" for i in range(40)),
    "again the same words " * 30,
]


def test_prose_and_other(spark):
    rows = [(i, t) for i, t in enumerate(PROSE)] + [(100 + i, t) for i, t in enumerate(OTHER)] + [(900, None), (901, ""), (902, " \n\t ")]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id bigint, text string, row int, piece string")
    assert sorted(r["doc_id"] for r in quality.not_prose(df).collect()) == [100 + i for i in range(len(OTHER))]
    assert {r["doc_id"] for r in quality.judged(df).collect()}.isdisjoint({900, 901, 902})


def test_repeated_rows_are_each_judged_by_themselves(spark):
    df = spark.createDataFrame([(1, PROSE[0])] * 5 + [(2, OTHER[0])] * 3, "doc_id bigint, text string")
    assert [r["doc_id"] for r in quality.not_prose(df).collect()] == [2] and quality.judged(df).count() == 8
    assert quality.not_prose(df.limit(0)).count() == 0


def test_long_text(spark):
    df = spark.createDataFrame([(1, (PROSE[0] + "\n") + "\n".join(f"X-{i}, {i}" for i in range(50_000)))], "doc_id bigint, text string")
    assert quality.not_prose(df).count() == 1


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The dog ran.\nThe dog ran.\n\nA cat"), (2, None), (3, "?!")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    assert set(got) == {1, 3} and got[1]["n_words"] == 8 and got[1]["repeated_lines"] == 0.3333 and got[1]["punctuated_lines"] == 0.6667 and got[1]["common_words"] == 0.375 and got[3]["n_words"] == 0 and got[3]["symbol_ratio"] == 1.0


def test_statistics_in_any_language(spark):
    texts = ["Die Stapelläufe prüfen für uns.", "Пакет читает все записи.", "मूल पाठ यहाँ है।", "u\u0308ber 東京。", "été\u00a0–\u2003à"]
    df = spark.createDataFrame([*enumerate(texts), (9, "again the same words " * 30), (9, PROSE[0]), (10, "\u2028")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.statistics(df.where("doc_id <> 9")).collect()}
    assert [got[i]["n_words"] for i in range(5)] == [5, 4, 4, 2, 2] and got[10]["n_words"] == 0 and got[10]["prose_share"] == 0
    assert [round(got[i]["symbol_ratio"] * len(texts[i])) for i in range(5)] == [1, 1, 1, 1, 1]
    assert [got[i]["punctuated_lines"] for i in range(5)] == [1, 1, 1, 1, 0]
    assert got[0]["mean_word_length"] == 5.2 and got[1]["prose_share"] == 1
    junk, prose = sorted((r for r in quality.statistics(df.where("doc_id = 9")).collect()), key=lambda r: -r["gram_cover"])
    assert junk["gram_cover"] > 0.9 and (prose["gram_cover"], prose["prose_share"], prose["repeated_share"]) == (0, 1, 0)


def test_features_that_no_word_list_gives(spark):
    italian = "Il programma legge tutti i record del registro e poi scrive un rapporto. Gli operatori controllano sempre il saldo di ogni conto prima della notte."
    salad = "taow yng wysvw magrdxqdf iuixpznq oeh drb vjdku rdb uv ncfrotvh ygn hyztpjb msazv utogkbhfh pcbxdofi ltpar bb jwwqnby"
    phrase = ("the ledger of this branch is read by every nightly job and closed ") * 9
    paragraph = "\n\n".join([PROSE[0]] * 6)
    df = spark.createDataFrame([(1, italian), (2, salad), (3, phrase), (4, paragraph), (5, PROSE[0])], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.features(df).withColumn("is_prose", quality.is_prose()).collect()}
    assert [got[i]["is_prose"] for i in range(1, 6)] == [True, False, False, False, True]
    assert got[3]["gram_cover"] > 0.9 and got[4]["repeated_paragraph_chars"] > 0.8 and got[5]["gram_cover"] == 0 and 3.5 < got[5]["entropy"] < 4.6 and got[5]["word_length_spread"] > 1


def test_agreement(spark):
    docs = spark.createDataFrame([(1, PROSE[0]), (2, OTHER[0]), (3, PROSE[1]), (4, PROSE[1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "prose"), (1, "prose"), (2, "other"), (2, None), (3, "prose"), (3, "other"), (9, "prose")], "doc_id bigint, label string")
    assert sorted(map(tuple, quality.agreement(docs, labels).collect())) == [("other", False, 1), ("prose", True, 1)]


def test_features_do_not_depend_on_the_rows_around(spark):
    texts = PROSE + OTHER + ["", "\u2028", "x", "été", "東京", "a" * 100_000]
    one = {r["doc_id"]: tuple(r) for r in quality.features(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(1)).collect()}
    each = {}
    for r in quality.features(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(len(texts), "doc_id")).collect():
        each[r["doc_id"]] = tuple(r)
    assert one.keys() == each.keys() and all(abs(x - y) < 1e-9 for i in one for x, y in zip(one[i], each[i], strict=True))
