import pytest

from orefield.llm import syntax

COBOL = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. P1.
      * a remark with ( and '
       AUTHOR. THE OPEN TEAM.
       ENVIRONMENT DIVISION.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       COPY BOOK1 REPLACING ==A-B== BY ==C-D==.
       01  WS-A PIC ZZ,ZZ9.99.
       01  WS-B PIC S9(5)V99 COMP-3 VALUE ZERO.
       01  WS-C PIC X(20) VALUE "END-EXEC (OLD".
       PROCEDURE DIVISION.
       0000-MAIN.
           PERFORM 1000-A UNTIL WS-A = 'Y'
           PERFORM VARYING WS-I FROM 1 BY 1
               UNTIL WS-I > 3
               MOVE 'it''s' TO WS-C
           END-PERFORM
           GOBACK.
       1000-A.
           EVALUATE WS-A
               WHEN 'X'
                   READ F-FILE INTO WS-B
                       AT END MOVE 'N' TO WS-C
                   END-READ
               WHEN OTHER
                   CONTINUE
           END-EVALUATE
           IF WS-A NOT > 5
               ADD 1 TO WS-B
           ELSE
               SUBTRACT WS-A FROM WS-B
           END-IF
           EXEC SQL
               SELECT A, B INTO :WS-A, :WS-B FROM T1 WHERE C = :WS-C
           END-EXEC
           COMPUTE WS-A = WS-B * WS-I + 5
           STRING 'A' DELIMITED BY SIZE WS-A DELIMITED BY SPACE INTO WS-C
           CALL 'SUB' USING WS-A WS-B
           GO TO 1000-EXIT.
       1000-EXIT.
           CONTINUE.
       END PROGRAM P1.
"""
BOOK = "      * layout\n       01  REC.\n         05  A PIC X(3).\n           88  A-ON VALUE 'Y'.\n         05  B\n               OCCURS 4 TIMES\n               PIC -(7)9.99.\n"
JCL = "//J1       JOB (A,1),'IT''S',\n//             CLASS=A\n//*  REMARK <<<<<<< OLD (\n//S1       EXEC PGM=P1,COND=(4,LT)\n//A        DD DSN=X.Y,DISP=(NEW,CATLG,DELETE),\n//             SPACE=(CYL,(1,2)),DCB=(RECFM=FB,LRECL=80)\n//SYSIN    DD *\n  ======= TAX (\n/*\n//\n"
DDL = "-- draft ( '\nCREATE TABLE T1 (\n A_ID DECIMAL(9,2) NOT NULL,\n B CHAR(3) DEFAULT 'A',\n CONSTRAINT PK1 PRIMARY KEY (A_ID)\n);\nCREATE INDEX I1 ON T1 (B);\nCREATE VIEW V1 AS\n SELECT A_ID, B FROM T1\n WHERE A_ID > 5;\nCREATE TRIGGER G1\n AFTER INSERT ON T1\n REFERENCING NEW AS N\n FOR EACH ROW MODE DB2SQL\n BEGIN ATOMIC\n INSERT INTO L1 (A) VALUES (N.A_ID);\n END;\n"
GOES_ON = lambda card: card.ljust(71) + "X\n"
BMS = (
    "* SCREEN\n" + GOES_ON("M1       DFHMSD TYPE=&SYSPARM,LANG=COBOL,MODE=INOUT,") + "               STORAGE=AUTO,CTRL=FREEKB\nA1       DFHMDI SIZE=(24,80),LINE=1,COLUMN=1\n"
    + GOES_ON("F1       DFHMDF POS=(1,36),LENGTH=8,ATTRB=(NORM,PROT),") + "               INITIAL='FEE (F3'\n         DFHMSD TYPE=FINAL\n         END\n"
)
SOUND = {"cobol": COBOL, "copybook": BOOK, "jcl": JCL, "ddl": DDL, "bms": BMS}
BREAKS = {
    "cobol": [
        ("           END-PERFORM\n", ""), ("           END-IF\n", ""), ("           END-EVALUATE\n", ""), ("           END-EXEC\n", ""), ("'it''s' TO", "'it''s TO"), ("MOVE 'N' TO WS-C", "MOVE 'N' TO"), ("           GOBACK.", "           GOBACK"), ("ADD 1 TO WS-B", "ADD 1 WS-B"), ("PIC S9(5)V99", "PIC S9(5V99"),
        ("PIC S9(5)V99", "PIC @%#@"), ("EVALUATE WS-A\n", "EVALUTE WS-A\n"), ("1000-EXIT.\n           CONTINUE.\n       END PROGRAM P1.\n", "1000-EXIT.\n           CONT"), ("       DATA DIVISION.", "       DATA DIVSION."), ("       GO TO", "<<<<<<< HEAD\n       GO TO"), ("01  WS-A PIC", "01  PIC"), ("WS-B * WS-I", "WS-B * * WS-I"),
        ("           CALL 'SUB'", "BAD        CALL 'SUB'"), ("DELIMITED BY SIZE WS-A", "BY SIZE WS-A"), ("FROM T1 WHERE", "T1 WHERE"),
    ],
    "copybook": [("PIC X(3).", "PIC X(3)"), ("05  A PIC", "A PIC"), ("-(7)9.99.", "-(7)9.99"), ("VALUE 'Y'.", "VALUE 'Y."), ("OCCURS 4 TIMES", "OCCURS TIMES X"), ("       01  REC.", "       PROCEDURE DIVISION.")],
    "jcl": [("//             CLASS", "             CLASS"), ("'IT''S',", "'IT''S,"), ("(1,2)),DCB", "(1,2),DCB"), (" EXEC ", " EXCE "), ("DISP=(NEW,CATLG,DELETE),\n", "DISP=(NEW,CATLG,DELETE)\n"), ("//J1       JOB (A,1),'IT''S',\n//             CLASS=A\n", ""), ("//S1       EXEC PGM=P1,COND=(4,LT)", "//S1       EXEC PGM="), ("//A  ", "=======\n//A  ")],
    "ddl": [(");\nCREATE INDEX", "\nCREATE INDEX"), ("PRIMARY KEY", "PRIMARY"), ("'A',", "'A,"), (" END;\n", ""), ("WHERE A_ID > 5;", "WHERE A_ID > 5"), ("CREATE TABLE", "CREATE"), ("NOT NULL,\n", "NOT NULL\n"), ("(9,2)", "(9,2"), (" END;\n", " END;\n>>>>>>> rel/a\n")],
    "bms": [("         DFHMSD TYPE=FINAL\n", ""), (GOES_ON("F1       DFHMDF POS=(1,36),LENGTH=8,ATTRB=(NORM,PROT),"), "F1       DFHMDF POS=(1,36),LENGTH=8,ATTRB=(NORM,PROT),\n"), ("POS=(1,36)", "POS=(1,36"), ("DFHMDF", "DFHMFD"), ("(F3'", "(F3"), ("               INITIAL", "          INITIAL"), ("A1       DFHMDI", "A1 DFHMDF POS=(1,1)\nA1       DFHMDI")],
}


@pytest.mark.parametrize("language", sorted(SOUND))
def test_sound_in_any_case_and_line_ends(language):
    text = SOUND[language]
    for t in (text, text.lower(), text.replace("\n", "\r\n"), text.replace("\n", "\r"), text.rstrip("\n")):
        assert syntax.fault(t, language) is None


def test_sequence_numbers_are_no_text():
    numbered = "".join(f"{i * 100:06d}{line[6:]}\n" for i, line in enumerate(COBOL.splitlines(), 1))
    assert syntax.fault(numbered, "cobol") is None


@pytest.mark.parametrize("language,old,new", [(k, a, b) for k, v in BREAKS.items() for a, b in v])
def test_broken(language, old, new):
    assert old in SOUND[language]
    assert syntax.fault(SOUND[language].replace(old, new, 1), language)


@pytest.mark.parametrize("language", sorted(SOUND))
def test_text_of_another_kind(language):
    others = [t for k, t in SOUND.items() if k != language] + ["<html><body><p>Hi</p></body></html>", "Nothing to review here.", "A,B\n1,2\n", '{"a": [1, 2]}', "", " \n"]
    assert all(syntax.fault(t, language) for t in others)


def test_files_and_rates(spark):
    rows = [("a/X.CBL", COBOL), ("a/x.cpy", BOOK[:-3]), ("b/y.Jcl", JCL), ("b/z.txt", "?"), ("c/n.sql", None), (None, "x"), ("b/e.map", ""), ("b/e.map", ""), ("d/long.ddl", DDL * 2000)]
    df = spark.createDataFrame([(f, t, f[0] if f else None, "l", "f") for f, t in rows], "source_file string, text string, codebase_id string, language string, fault string")
    assert sorted(r[0] for r in syntax.broken_files(df).collect()) == ["a/x.cpy", "b/e.map"]
    assert {(r["codebase_id"], r["language"]): (r["n_files"], r["n_broken"]) for r in syntax.rates(df).collect()} == {("a", "cobol"): (1, 0), ("a", "copybook"): (1, 1), ("b", "jcl"): (1, 0), ("b", "bms"): (2, 2), ("d", "ddl"): (1, 0)}
    assert syntax.broken_files(df.limit(0)).count() == 0


_PROGRAM = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P1.\n       ENVIRONMENT DIVISION.\n       INPUT-OUTPUT SECTION.\n       FILE-CONTROL.\n           SELECT F-A ASSIGN TO OUTA.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01  A PIC X.\n       PROCEDURE DIVISION.\n       0000-A.\n           {}.\n"
_JOB = "//J1       JOB (A),'X'\n//S1       EXEC PGM=P1\n{}\n"
_TABLE = "CREATE TABLE T (A INTEGER NOT NULL, B CHAR(3));\n{}\n"

GOOD = [
    *[("cobol", _PROGRAM.format(s)) for s in (
        "IF A = B AND (C = D OR NOT (E > 1)) CONTINUE END-IF", "COMPUTE X = ((A + B) * (C - 2)) / D", "MOVE FUNCTION TRIM(A) TO B", "MOVE FUNCTION UPPER-CASE(FUNCTION TRIM(A (1:3))) TO B", "IF FUNCTION LENGTH(A) > 3 CONTINUE END-IF",
        "MOVE A(1) TO B(I + 1)(2:3)", "MOVE ALL '*' TO A", "MOVE LENGTH OF A TO B", "IF A(1:2) = 'X' CONTINUE END-IF",
        "EXEC SQL SELECT COUNT(*) INTO :N FROM T1 END-EXEC", "EXEC SQL SELECT A, MAX(B) INTO :X, :Y :IND FROM T1 WHERE C IN (1,2) AND D BETWEEN 1 AND 9 GROUP BY A ORDER BY 1 DESC FETCH FIRST 1 ROW ONLY WITH UR END-EXEC",
        "EXEC SQL UPDATE T1 SET A = A + 1, B = :WS-B WHERE CURRENT OF C1 END-EXEC", "EXEC SQL DECLARE C1 CURSOR WITH HOLD FOR SELECT A FROM T1 X LEFT JOIN T2 Y ON X.A = Y.A WHERE NOT EXISTS (SELECT 1 FROM T3) END-EXEC",
        "EXEC SQL FETCH C1 INTO :A, :B END-EXEC", "EXEC SQL COMMIT END-EXEC", "EXEC SQL INSERT INTO T1 (A) SELECT B FROM T2 END-EXEC", "EXEC CICS SEND MAP('M1') FROM(A) ERASE END-EXEC", "XML GENERATE A FROM B",
    )],
    *[("jcl", _JOB.format(s)) for s in (
        "//A        DD DSN=X.Y,DISP=(NEW,\n//             CATLG,DELETE)", "//A        DD DSN=X,DCB=(RECFM=FB,\n//  LRECL=80),\n//  SPACE=(CYL,(1,\n//  2))", "//A        DD *,DLM=ZZ\n//NOT A CARD\n/* NOR THIS\nZZ", "//A        DD DATA\n//X EXEC PGM=Y\n/*", "//A        DD DATA,DLM='@@'\n/*\n@@",
        "//S2       EXEC PGM=P2,PARM='".ljust(71, "A") + "\n//             REST OF IT'", "// IF (S1.RC = 0) THEN\n//S2       EXEC PGM=P2\n// ELSE\n//S3       EXEC PGM=P3\n// ENDIF", "// IF RC > 4 |\n//   ABEND THEN\n//S2 EXEC P2\n// ENDIF", "//PR       PROC A=,B=2\n//S2       EXEC PGM=P2\n//         PEND", "// SET A=", "//S2 EXEC PROC1,A=,B='X'",
    )],
    *[("ddl", _TABLE.format(s)) for s in (
        "CREATE VIEW V AS SELECT COUNT(*) AS N FROM T WHERE (A=1) ORDER BY N;", "CREATE VIEW V AS SELECT A FROM T UNION ALL SELECT A FROM (SELECT A FROM T) X;", "CREATE TABLE U (A INTEGER GENERATED ALWAYS AS IDENTITY (START WITH 1, INCREMENT BY 1), X XML, D DATE NOT NULL WITH DEFAULT, C CHAR(8) FOR BIT DATA, PRIMARY KEY (A)) IN DB1.TS1;",
        "/* a\n ; block */ COMMIT;", "CREATE PROCEDURE P (IN A INTEGER, OUT B CHAR(3)) LANGUAGE SQL BEGIN DECLARE X INTEGER DEFAULT 0; IF A > 1 THEN SET B = 'X'; ELSE SELECT B INTO B FROM T WHERE A = 1; END IF; WHILE X < 3 DO SET X = X + 1; END WHILE; END;", "CREATE TABLESPACE TS1 IN DB1 USING STOGROUP SG1 PRIQTY 48;", "SET CURRENT SCHEMA = 'A';",
        "CREATE UNIQUE INDEX I ON T (A ASC, B DESC) CLUSTER;", "ALTER TABLE T ADD CONSTRAINT F FOREIGN KEY (B) REFERENCES U (A) ON DELETE SET NULL;", "ALTER TABLE T ADD COLUMN C DECIMAL(9,2) NOT NULL DEFAULT 0;", "GRANT SELECT, UPDATE (A) ON TABLE T TO PUBLIC, U1;", "CREATE VIEW V AS SELECT CASE WHEN A > 1 THEN 'X' ELSE 'Y' END, CAST(A AS CHAR(3)), COALESCE(B, '') || 'Z', CURRENT DATE - 1 MONTH FROM T;",
        "CREATE TRIGGER G AFTER UPDATE OF A ON T REFERENCING NEW AS N OLD AS O FOR EACH ROW MODE DB2SQL WHEN (N.A > O.A) BEGIN ATOMIC UPDATE U SET A = (SELECT MAX(A) FROM T); SIGNAL SQLSTATE '75000'; END;", "CREATE TRIGGER G NO CASCADE BEFORE INSERT ON T REFERENCING NEW AS N FOR EACH ROW SET N.B = 'A';", "INSERT INTO T VALUES (1, 'A'), (2, DEFAULT);", "WITH X AS (SELECT A FROM T) SELECT * FROM X;", "COMMENT ON COLUMN T.A IS 'IT''S';", "DROP TABLE A.T;",
    )],
]
BAD = [
    *[("cobol", _PROGRAM.format(s)) for s in (
        "IF (A = B CONTINUE END-IF", "IF A = B) CONTINUE END-IF", "COMPUTE X = ((A + B", "COMPUTE X = A + B))", "MOVE FUNCTION TRIM(A TO B", "EXEC SQL SELECT A INTO :X T1 END-EXEC", "EXEC SQL SELECT A INTO :X FROM T1 WHERE C IN (1,2 END-EXEC", "EXEC SQL UPDATE T1 A = 1 END-EXEC", "EXEC SQL SELCT A FROM T END-EXEC",
        "EXEC SQL DECLARE C1 CURSOR FOR SELECT FROM T1 END-EXEC", "EXEC CICS SEND MAP('M1' END-EXEC",
    )],
    ("cobol", _PROGRAM.format("GOBACK").replace("ASSIGN TO OUTA.", "ASSIGN TO OUTA")), ("cobol", _PROGRAM.format("GOBACK").replace("SELECT F-A ASSIGN", "SELECT ASSIGN")),
    *[("jcl", _JOB.format(s)) for s in (
        "// IF (S1.RC = 0) THEN\n//S2       EXEC PGM=P2", "// ENDIF", "//         PEND", "// ELSE", "// IF (S1.RC = 0)\n//S2       EXEC PGM=P2\n// ENDIF", "// IF (RC = 0 THEN\n//S2 EXEC P2\n// ENDIF", "// IF RC = 0 THEN\n// ELSE\n// ELSE\n// ENDIF", "//A        DD DISP=(NEW,\n//             CATLG", "//A        DD DISP=(NEW,CATLG\n//             DELETE)", "//S2       EXEC PGM=P2,PARM='OPEN\n//             REST'", "//PR       PROC\n//S2       EXEC PGM=P2",
        "//A        DD DISP=(NEW,\n//             CATLG)),\n//             UNIT=X", "// IF RC = 0 THEN\n//PR PROC\n// ENDIF",
    )],
    *[("ddl", _TABLE.format(s)) for s in (
        "CREATE VIEW V AS SELECT COUNT(* FROM T;", "CREATE VIEW V AS SELECT A FROM T WHERE (A=1;", "CREATE VIEW V AS SELECT A FROM T UNION;", "CREATE TABLE U (A INTEGER GENERATED ALWAYS IDENTITY);", "CREATE TABLE U (A INTEGER B CHAR(3));", "CREATE TABLE U (A INTEGER,);", "CREATE TABLE U A INTEGER);", "CREATE U (A INTEGER);", "/* open COMMIT;", "CREATE PROCEDURE P () BEGIN SET A = 1; ", "CREATE PROCEDURE P () BEGIN IF A = 1 THEN SET A = 2; END; END;",
        "CREATE TABLE U (A INTEGER)\nCREATE INDEX I ON U (A);", "CREATE INDEX I T (A);", "INSERT INTO T VALUES (1,);", "UPDATE T SET A = WHERE B = 1;", "DELETE T WHERE A = ;", "SELECT A FORM T;", "CREATE TRIGGER G AFTER INSERT T FOR EACH ROW BEGIN ATOMIC DELETE FROM U; END;", "ALTER T ADD COLUMN C INTEGER;", "COMMIT",
    )],
]


@pytest.mark.parametrize("language,text", GOOD)
def test_ordinary_code_is_sound(language, text):
    assert syntax.fault(text, language) is None
    assert syntax.fault(text.lower(), language) is None


@pytest.mark.parametrize("language,text", BAD)
def test_unbalanced_and_unfinished_code_is_broken(language, text):
    assert syntax.fault(text, language)


def test_deep_nesting_and_long_texts_end():
    assert syntax.fault("COMMIT;\nSELECT " + "(" * 5000 + "1" + ")" * 5000 + " FROM T;\n", "ddl") == "nested too deeply"
    assert syntax.fault("SELECT " + "+".join(["A"] * 50_000) + " FROM T;\n", "ddl") is None
