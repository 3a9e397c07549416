"""Extractors on invented sources: nodes, edges and units are compared with what the source says."""

import json

import pytest

from orefield.operators import extract as X

COBOL = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. ORDPOST.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-TOTAL            PIC 9(7)V99.
       01  WS-FLAG             PIC X VALUE 'N'.
           88  WS-DONE         VALUE 'Y'.
       01  WS-BAD              PIC @#.
       COPY ORDREC REPLACING ==OLD-ID== BY ==NEW-ID==.
       PROCEDURE DIVISION.
       0000-START.
           PERFORM 1000-READ THRU 1000-EXIT
           PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3
               ADD 1 TO WS-TOTAL
           END-PERFORM.
           PERFORM MISSING-ONE.
           GO TO 9000-END.
       1000-READ.
      * CALL 'NOT-THIS' in a remark
           IF WS-DONE
               CALL 'RATECALC' USING WS-TOTAL
           END-IF.
           DISPLAY 'PERFORM NOT-THIS'.
           EXEC SQL
               SELECT QTY INTO :WS-TOTAL FROM STOCK WHERE K = :WS-K
           END-EXEC.
           EXEC SQL UPDATE LEDGER SET A = :B END-EXEC.
       1000-EXIT.
           EXIT.
       9000-END.
           MOVE ==OLD-ID== TO X.
           GOBACK.
"""


def files(spark, **named):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v, "cb", "extra") for k, v in named.items()], "source_file string, text string, codebase_id string, nodes string")


def ids(df, kind=None):
    return sorted(r["id"] for r in df.collect() if kind in (None, r["type"]))


def edges(df):
    return sorted({(r["src"], r["type"], r["dst"]) for r in df.collect()})


def props(df, id_):
    return [json.loads(r["properties"]) for r in df.where(f"id = '{id_}'").collect()]


def test_cobol(spark):
    r = X.cobol(files(spark, src__ORDPOST_dot_cbl=COBOL))
    assert ids(r.nodes, "Paragraph") == [f"Paragraph:cb:ORDPOST.{p}" for p in ("0000-START", "1000-EXIT", "1000-READ", "9000-END")]
    assert ids(r.nodes, "Field") == [f"Field:cb:ORDPOST.{f}" for f in ("WS-BAD", "WS-FLAG", "WS-TOTAL")]
    assert ids(r.nodes, "Program") == ["Program:cb:ORDPOST", "Program:cb:RATECALC"] and ids(r.nodes, "DB2Table") == ["DB2Table:cb:LEDGER", "DB2Table:cb:STOCK"]
    p = "Paragraph:cb:ORDPOST."
    assert edges(r.edges) == sorted([
        (p + "0000-START", "PERFORMS", p + "1000-READ"), ("Program:cb:ORDPOST", "PERFORMS", p + "MISSING-ONE"), (p + "0000-START", "PERFORMS", p + "9000-END"), (p + "1000-READ", "CALLS", "Program:cb:RATECALC"),
        ("Program:cb:ORDPOST", "INCLUDES", "Copybook:cb:ORDREC"), ("Program:cb:ORDPOST", "READS", "DB2Table:cb:STOCK"), ("Program:cb:ORDPOST", "WRITES", "DB2Table:cb:LEDGER"),
    ])
    start, read = props(r.nodes, p + "0000-START")[0], props(r.nodes, p + "1000-READ")[0]
    assert (start["cyclomatic_complexity"], start["goto_density"], start["statement_count"]) == (2, 0.3333, 3)
    assert read["cyclomatic_complexity"] == 3 and read["calls"] == ["RATECALC"]  # IF counts in END-IF too
    assert props(r.nodes, "Program:cb:ORDPOST")[0]["anomalies"] == ["malformed field WS-BAD"]
    assert {x["name"]: x["source"] for x in r.units.collect()}["ORDPOST.9000-END"] == "9000-END.\nMOVE NEW-ID TO X.\nGOBACK."


def test_cobol_broken_sql_and_code_before_paragraphs(spark):
    bare = "       PROGRAM-ID. P1.\n       PROCEDURE DIVISION.\n           CALL 'SUB'.\n           PERFORM A.\n       A.\n           EXIT.\n"
    r = X.cobol(files(spark, a_dot_cbl=bare, b_dot_CBL="       PROCEDURE DIVISION.\n       M.\n           EXEC SQL SELECT 1\n", c_dot_cbl="", d_dot_cob="       PROCEDURE DIVISION.\n           CALL 'X'.\n"))
    assert ("Paragraph:cb:P1.A", "CALLS", "Program:cb:SUB") in edges(r.edges) and ("Paragraph:cb:D.MAIN", "CALLS", "Program:cb:X") in edges(r.edges)
    assert props(r.nodes, "Program:cb:B")[0]["anomalies"] == ["unterminated EXEC SQL block"]
    assert ids(r.nodes, "Paragraph") == ["Paragraph:cb:B.M", "Paragraph:cb:D.MAIN", "Paragraph:cb:P1.A"]


def test_replacing_changes_the_hash(spark):
    a, b = (X.cobol(files(spark, P_dot_cbl=COBOL.replace("NEW-ID", new))).units for new in ("NEW-ID", "OTHER-ID"))
    h = lambda u: {r["name"]: r["content_hash"] for r in u.collect()}
    assert h(a)["ORDPOST.9000-END"] != h(b)["ORDPOST.9000-END"] and h(a)["ORDPOST.1000-READ"] == h(b)["ORDPOST.1000-READ"]


def test_copybook(spark):
    text = "       01  REC.\n           05  AMT PIC 9(4)\n                   OCCURS 3 TIMES.\n           05  ST REDEFINES AMT PIC X.\n             88  OPEN-ST VALUE 'O'.\n             88  SHUT-ST VALUE 'S'.\n           05  BAD PIC @@.\n"
    r = X.copybook(files(spark, x__REC1_dot_cpy=text))
    assert ids(r.nodes) == ["Copybook:cb:REC1"] + [f"Field:cb:REC1.{f}" for f in ("AMT", "BAD", "REC", "ST")]
    assert props(r.nodes, "Field:cb:REC1.AMT")[0] == {"level": 5, "occurs": 3, "parent_copybook": "REC1", "pic": "9(4)"}
    st = props(r.nodes, "Field:cb:REC1.ST")[0]
    assert st["condition_names"] == ["OPEN-ST", "SHUT-ST"] and st["redefines"] == "AMT"
    assert {x["id"]: x["parse_confidence"] for x in r.nodes.collect()}["Copybook:cb:REC1"] == 0.5 and r.units.count() == 1


JCL = """\
//NI-GHT   JOB (ACC,1),'RUN',CLASS=A,
//             MSGCLASS=X
//* a remark
//S-1      EXEC PGM=LOADER,COND=(4,LT)
//IN       DD DSN=A.IN,
//             X0=0,
//             X1=1,
//             X2=2,
//             X3=3,
//             X4=4,
//             X5=5,
//             X6=6,
//             X7=7,
//             X8=8,
//             DISP=SHR
//OUT      DD DSN=A.OUT,
//             DISP=(NEW,CATLG,DELETE)
//LOG      DD DSN=A.LOG,DISP=(MOD,DELETE)
//SYSIN    DD *
  SORT FIELDS=(1,2)
/*
//S2       EXEC MYPROC
//X        FROB A=1
////*
//N        DD DSN=A.NONE
"""


def test_jcl(spark):
    r = X.jcl(files(spark, NIGHT_dot_jcl=JCL))
    assert ids(r.nodes, "JCLJob") == ["JCLJob:cb:NI-GHT"] and ids(r.nodes, "Dataset") == [f"Dataset:cb:A.{x}" for x in ("IN", "LOG", "NONE", "OUT")]
    steps = [i for i in ids(r.nodes, "JCLStep")]
    assert "JCLStep:cb:S-1" in steps and "JCLStep:cb:S2" in steps and len(steps) == 4 and any("ANOMALY" in s for s in steps)
    s = "JCLStep:cb:S-1"
    assert edges(r.edges) == sorted([(s, "EXECUTES", "Program:cb:LOADER"), (s, "READS", "Dataset:cb:A.IN"), (s, "WRITES", "Dataset:cb:A.OUT"), (s, "READS", "Dataset:cb:A.LOG"), (s, "WRITES", "Dataset:cb:A.LOG")])
    assert props(r.nodes, "JCLJob:cb:NI-GHT")[0] == {"accounting": "(ACC,1)", "class": "A", "msgclass": "X"}
    assert props(r.nodes, s)[0] == {"cond": "4,LT", "exec_kind": "PROGRAM", "parent_job": "NI-GHT", "program": "LOADER", "step_number": 1}
    assert props(r.nodes, "JCLStep:cb:S2")[0]["proc"] == "MYPROC" and "SORT FIELDS" in {u["name"]: u["source"] for u in r.units.collect()}["NI-GHT.S-1"]


DDL = """\
-- CREATE TABLE NOT_THIS (A INT);
CREATE TABLE CUST (ID BIGINT NOT NULL, NAME VARCHAR(20), AMT DECIMAL(9,2), PRIMARY KEY (ID), CONSTRAINT C1 CHECK (AMT > 0));
CREATE TABLE ORD (ID BIGINT PRIMARY KEY, CID BIGINT, CONSTRAINT FK1 FOREIGN KEY (CID) REFERENCES CUST (ID) ON DELETE CASCADE) IN TS1;
CREATE UNIQUE INDEX IX1 ON ORD (CID);
CREATE VIEW V1 AS SELECT C.ID FROM CUST C JOIN ORD O ON O.CID = C.ID WHERE C.ID IN (SELECT ID FROM OTHERS);
CREATE TRIGGER T1 AFTER UPDATE OF NAME ON CUST REFERENCING NEW AS N FOR EACH ROW MODE DB2SQL BEGIN ATOMIC INSERT INTO AUDIT (ID) VALUES (N.ID); IF 1 = 1 THEN UPDATE ORD SET ID = 1; END IF; END;
CREATE TRIGGER T2 NO CASCADE BEFORE INSERT ON ORD FOR EACH ROW MODE DB2SQL BEGIN ATOMIC DELETE FROM CUST; END;
CREATE PROCEDURE P1 (IN A DECIMAL(9,2), OUT B INT) LANGUAGE SQL BEGIN IF A > 1 THEN CALL P2(A); END IF; CALL P1(A); INSERT INTO AUDIT VALUES (1); SELECT X INTO B FROM CUST; END PROCEDURE;
"""


def test_ddl_triggers_procedures(spark):
    f = files(spark, db_dot_sql=DDL)
    r = X.ddl(f)
    assert ids(r.nodes, "DB2Table") == ["DB2Table:cb:CUST", "DB2Table:cb:ORD"] and len(ids(r.nodes, "DB2Column")) == 5 and ids(r.nodes, "View") == ["View:cb:V1"]
    assert ids(r.nodes, "Constraint") == [f"Constraint:cb:{c}" for c in ("C1", "CUST_PK", "FK1", "IX1", "ORD_PK")]
    assert edges(r.edges) == sorted([("DB2Table:cb:ORD", "CASCADES_TO", "DB2Table:cb:CUST"), ("View:cb:V1", "ABSTRACTS", "DB2Table:cb:CUST"), ("View:cb:V1", "ABSTRACTS", "DB2Table:cb:ORD")])
    assert props(r.nodes, "DB2Column:cb:CUST.ID")[0] == {"is_pk": True, "not_null": True, "parent_table": "CUST", "type": "BIGINT"}
    assert props(r.nodes, "DB2Column:cb:CUST.AMT")[0]["type"] == "DECIMAL(9,2)"
    t = X.triggers(f)
    assert edges(t.edges) == sorted([("Trigger:cb:T1", "FIRES_ON", "DB2Table:cb:CUST"), ("Trigger:cb:T2", "FIRES_ON", "DB2Table:cb:ORD"), ("Trigger:cb:T1", "TRIGGERS_TRIGGER", "Trigger:cb:ON:AUDIT:INSERT"), ("Trigger:cb:T1", "TRIGGERS_TRIGGER", "Trigger:cb:ON:ORD:UPDATE")])
    p = X.procedures(f)
    me = "StoredProcedure:cb:P1"
    assert edges(p.edges) == sorted([(me, "INVOKES_PROC", "StoredProcedure:cb:P2"), (me, "READS", "DB2Table:cb:CUST"), (me, "WRITES", "DB2Table:cb:AUDIT")])
    assert props(p.nodes, me)[0]["parameters"] == ["IN A DECIMAL(9,2)", "OUT B INT"]


def test_vsam_and_bms(spark):
    cob = "       PROGRAM-ID. V1.\n       ENVIRONMENT DIVISION.\n       FILE-CONTROL.\n           SELECT MAST ASSIGN TO MASTDD ORGANIZATION IS INDEXED\n             ACCESS MODE IS DYNAMIC RECORD KEY IS M-ID.\n           SELECT LOGF ASSIGN TO LOGDD ORGANIZATION IS LINE SEQUENTIAL.\n           SELECT ODD ASSIGN TO ODDDD.\n       DATA DIVISION.\n       FILE SECTION.\n       FD  MAST.\n       01  M-REC PIC X.\n       FD  LOGF.\n       01  L-REC PIC X.\n       PROCEDURE DIVISION.\n       A.\n           READ MAST RECORD.\n           READ MAST RECORD.\n           WRITE L-REC.\n           EXEC CICS SEND MAP('M1') END-EXEC.\n"
    r = X.vsam(files(spark, V1_dot_cbl=cob))
    assert ids(r.nodes) == ["Dataset:cb:LOGF", "VSAMDataset:cb:MAST", "VSAMDataset:cb:ODD"]
    assert edges(r.edges) == [("Program:cb:V1", "READS", "VSAMDataset:cb:MAST"), ("Program:cb:V1", "WRITES", "Dataset:cb:LOGF")]
    assert props(r.nodes, "VSAMDataset:cb:MAST")[0]["organization"] == "KSDS" and {x["id"]: x["parse_confidence"] for x in r.nodes.collect()}["VSAMDataset:cb:ODD"] == 0.8
    head = "SET1     DFHMSD TYPE=&SYSPARM,LANG=COBOL" + " " * 32 + "X\n               ,MODE=INOUT\n"
    screen = head + "M1       DFHMDI SIZE=(24,80)\nF1       DFHMDF POS=(1,2),LENGTH=3,ATTRB=(NORM,PROT),INITIAL='HI'\nF2       DFHMDF LENGTH=3\n         DFHMSD TYPE=FINAL\n         END\n"
    b = X.bms(files(spark, S_dot_bms=screen, V1_dot_cbl=cob))
    p = props(b.nodes, "CICSMap:cb:SET1")[0]
    assert (p["maps"], p["fields_seen"], p["final_seen"], p["anomalies"]) == (["M1"], 2, True, ["missing POS"]) and p["fields"][0]["initial"] == "HI"
    assert edges(b.edges) == [("Program:cb:V1", "RENDERS_ON", "CICSMap:cb:M1")]


def test_all_together(spark):
    made = X.extract(files(spark, ORDPOST_dot_cbl=COBOL, RATECALC_dot_cbl=COBOL.replace("ORDPOST", "RATECALC"), NIGHT_dot_jcl=JCL, db_dot_sql=DDL, readme_dot_txt="nothing", empty_dot_jcl=""))
    merged = {r["id"]: r for r in X.merged_nodes(made.nodes).collect()}
    assert merged["Program:cb:RATECALC"]["parse_confidence"] == 0.5  # the real program, not the placeholder of its caller
    assert X.merged_edges(made.edges).count() == len(edges(made.edges))
    n = {(r["what"], r["kind"]): r["n"] for r in X.counts(made).collect()}
    assert n["unit", "paragraph"] == 8 and n["node", "Trigger"] == 2
    assert X.unit_tokens(made.units).count() >= 5


@pytest.mark.parametrize("kind", sorted(X.EXTRACTORS))
def test_empty_and_null_texts(spark, kind):
    f = spark.createDataFrame([("a.cbl", None, "cb"), ("a.cpy", None, None), ("a.jcl", "", "cb"), ("a.sql", None, "cb"), (None, "x", "cb"), ("a.bms", "\n", "cb")], "source_file string, text string, codebase_id string")
    for some in (f, f.limit(0)):
        r = X.EXTRACTORS[kind](some)
        assert X.merged_edges(r.edges).count() == 0 and X.merged_nodes(r.nodes).count() <= 3 and r.units.count() >= 0
