"""Text forms over all letters, against Python."""

import re
import unicodedata

from ledgerloom.plans import catalogue

LABELS = ["Café tab\t x", "출하 순중량", "ＣＮ　code", "Masse  nette (é)", " plain label ", "", None]


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_labels_of_any_letters_are_composed(spark, tmp_path):
    rows = list(enumerate(LABELS))
    write(spark, tmp_path, "candidates", [*rows, rows[0]], "cand_id long, raw_label string")
    got = sorted(tuple(r) for r in catalogue.QUERIES["text_composed"](spark, str(tmp_path)).collect())
    assert got == [(i, None if x is None else " ".join(unicodedata.normalize("NFC", x).split())) for i, x in rows]


def test_search_forms_are_folded(spark, tmp_path):
    rows = [(0, "Große Ｓtraße"), (1, unicodedata.normalize("NFD", "출하 중량")), (2, None), (3, "")]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in catalogue.QUERIES["text_normalize_folded"](spark, str(tmp_path)).collect())
    fold = lambda t: re.sub("[^0-9a-z가-힣]+", " ", unicodedata.normalize("NFKC", t).casefold()).strip()
    assert got == [(i, None if t is None else fold(t)) for i, t in rows]
