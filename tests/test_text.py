import hashlib
import random
import re

from pyspark.sql import functions as F

from orefield.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_content_hash_equals_line_by_line_definition(spark):
    rnd = random.Random(1)
    samples = ["", "\n", "a", "a \t\r\nb \n", "x\x0by\x1c  z　"] + ["".join(rnd.choice("ab \t\r\n\x0b\x85  ") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    want = [hashlib.sha256("\n".join(x.rstrip() for x in s.splitlines()).encode()).hexdigest() for s in samples]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").orderBy("i").select(T.content_hash(F.col("s"))).collect()]
    assert got == want


def test_content_area(spark):
    lines = {"000100 MOVE A TO B.": "MOVE A TO B.", "      * remark": "", "      / eject": "", "      -   'more'": "   'more'", "short": "short", "1234567890": "1234567890", " " * 7 + "x" * 80: "x" * 65}
    for line, want in lines.items():
        assert one(spark, T.content_area(F.col("s")), s=line) == want, line


def test_redaction_chain_equals_pattern_by_pattern(spark):
    text = "id 123-45-6789 card 4111 1111 1111 1111 iban DE44500105175407324931 PASSWORD = abc, USER=me\nPASS x " + "ab12" * 10
    want = text
    for kind, pattern in T.REDACTIONS:
        want = re.sub(pattern, f"[REDACTED]:{kind}", want)
    assert one(spark, T.redact(F.col("s")), s=text) == want
    assert one(spark, T.redact(F.col("s"), overrides={"TEAM": "me"}), s="ask me") == "ask [REDACTED]:TEAM"
    counts = {r["kind"]: r["n"] for r in one(spark, T.redaction_counts(F.col("s")), s=text)}
    assert counts["SSN"] == 1 and counts["TOKEN"] == 1 and "ROUTING" not in counts
    assert one(spark, T.redact(F.col("s")), s="  pass secret1") == "[REDACTED]:FTP_CRED"


def test_small_functions(spark):
    assert one(spark, T.slug(F.col("s")), s="My Job_1") == "my-job-1"
    assert one(spark, T.token_estimate(F.col("s")), s="abc") == 1
    assert one(spark, T.squeeze(F.col("s")), s=" a \n b ") == "a b"
    assert one(spark, T.without_literals(F.col("s")), s="MOVE 'it''s' TO \"B\"") == "MOVE  TO "
    pairs = F.array(F.struct(F.lit("A").alias("from"), F.lit("B").alias("to")), F.struct(F.lit("B").alias("from"), F.lit("C").alias("to")))
    assert one(spark, T.replace_pairs(F.col("s"), pairs), s="==A== and ==B== and A") == "B and C and A"
