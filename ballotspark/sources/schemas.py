"""Explicit schemas of the files that the engine reads and writes."""

#: Spark DDL by table. `j` numbers a problem's samples from 0; ans_key is an integer in decimal digits.
SCHEMAS = {
    "problems": "id STRING, question STRING, answer STRING",
    "id_list": "id STRING",
    "quarantine": "id STRING, question STRING, current_label STRING, suggested_answer STRING",
    "generations": "id STRING, outputs ARRAY<STRING>, trunc ARRAY<BOOLEAN>, logp ARRAY<DOUBLE>",
    "verifier": "id STRING, orm ARRAY<DOUBLE>",
    "critiques": "id STRING, critique STRING, score DOUBLE",
    "refined": "id STRING, refined ARRAY<STRING>, `from` ARRAY<INT>",
    "teacher": "id STRING, bucket STRING, n_solved INT, answer BIGINT, outputs ARRAY<STRING>",
    "audit": "id STRING, gold BIGINT, our_maj BIGINT, dead BOOLEAN, outputs ARRAY<STRING>",
    "sft": "id STRING, question STRING, solution STRING, answer BIGINT, label INT",
    "negatives": "id STRING, question STRING, solution STRING, label INT",
    "pairs": "id STRING, question STRING, solution STRING, label INT, maj_wrong BOOLEAN",
    "external": "id STRING, question STRING, solution STRING, answer BIGINT, label INT, src STRING, had_box BOOLEAN",
    "teacher_sft": "id STRING, question STRING, solution STRING, answer BIGINT, src STRING, bucket STRING, n_solved INT",
    "preferences": "prompt STRING, chosen STRING, rejected STRING",
    "submission": "id STRING, answer STRING",
}
