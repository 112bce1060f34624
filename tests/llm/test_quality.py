import numpy as np
import pytest

from tarnline.llm import quality as Q

SCHEMA = "ingest_id long, source_doc_id string, text string, n_words string, code long"
PROSE = "The crew opens the valve before the shift and notes the reading in the log. Nobody starts the pump while the guard is off, because the seal is worn."
WRAPPED = "The crew opens the valve before the shift and\nnotes the reading in the log. Nobody starts the\npump while the guard is off, because the seal\nis worn."
LIST = "• Worn seal\n• Lock-out hasp\n• Gate valve, GP-207\n• Torque wrench\n• Drive shaft"
CONTENTS = "Worn seal ........ 4\nLock-out hasp ........... 7\nGate valve ....... 12\nTorque wrench ............. 19"
TABLE = "Tag\tLimit\tUnit\nGP-207\t12\t4.5\nHE-101\t99\t7.2\nflow meter\t21\t8.8\nKP-366\t15\t1.1"
JUNK = "]?</\\<{+<|@~>=$>]^$}#}!<@@&\\<>>>\\?^/|>\n][+&/=]}^{$$>[~{}<>|\\~^%%#*^?%}]<*%~#"


KEYWORDS = " ".join(["gate valve", "boiler drum", "flow meter", "heat exchanger", "screw auger", "belt conveyor", "spray dryer", "quench tank", "rotary feeder"] * 5)


def test_strung_key_words_are_junk():
    """A long line of words that no common word joins is junk; the same length of running words is not."""
    _, codes, kind, low = Q._decoded([PROSE])
    common = np.unique(Q._words_of(codes, kind, low)[2].view(np.int64))
    running = PROSE.replace(".", "").lower()
    s = Q.line_statistics([KEYWORDS, running, KEYWORDS + ".", "gate valve boiler drum"], common, common)
    assert Q.unpacked(s["code"])["strung"].tolist() == [1, 0, 0, 0] and Q.seed_labels(s["code"])[0] == Q.LABELS.index("junk")


def frame(spark, n=40):
    rows = []
    for i in range(n):
        for k, text in enumerate((PROSE, WRAPPED, LIST, CONTENTS, TABLE, JUNK)):
            rows.append((i * 10 + k, f"s{i % 3}", text.replace("worn", f"worn{'abcdefghij'[i % 10]}"), "x", 1))
    return spark.createDataFrame(rows + [(9001, None, None, "", 0), (9002, "s0", "", "", 0), (9003, "s0", " \n ", "", 0), (9004, None, PROSE.upper(), "", 0), (9004, None, PROSE.upper(), "", 0), (9005, None, (PROSE + " ") * 2000, "", 0)], SCHEMA)


def test_verdicts(spark, monkeypatch):
    monkeypatch.setattr("tarnline.llm.quality.repeated_lines", lambda df, *a: df.sparkSession.createDataFrame([], "row_id long, line_no long"))
    got = {r.ingest_id: r for r in Q.quality(frame(spark)).collect()}
    for i in range(40):
        assert [got[i * 10 + k].verdict for k in range(6)] == ["prose", "prose", "list", "list", "table", "junk"]
    assert [got[k].verdict for k in (9001, 9002, 9003, 9004, 9005)] == ["blank", "blank", "blank", "prose", "prose"]
    assert got[0].n_words == len(PROSE.split()) and got[0].punct_line_share == 1.0 and got[0].symbol_ratio == 0.0
    assert got[9001].n_words == 0 and got[9001].prose is None


def test_repeated_lines_are_set_aside(spark):
    rows = [(i, "s", f"{PROSE.replace('crew', 'crew' + chr(97 + i))}\nShare this page · mail · print · copy\nFollow us for updates\nAll rights reserved", "", 0) for i in range(20)]
    assert {r.verdict for r in Q.quality(spark.createDataFrame(rows, SCHEMA)).collect()} == {"prose"}


def test_nothing(spark):
    assert Q.not_prose(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoding_equals_plain_viterbi():
    rng = np.random.default_rng(2)
    model = Q.LineModel(rng.random(4) * 9, rng.random((4, 4)) * 9, rng.random((4, Q.CODES)))
    lengths = np.array([0, 3, 1, 7, 0, 2])
    codes = rng.integers(0, Q.CODES, lengths.sum())
    got, at = model.decode(codes, lengths), 0
    for n in lengths:
        mine = codes[at : at + n]
        best, back = None, []
        for t, c in enumerate(mine):
            if t == 0:
                best = model.first + model.emit[:, c]
                continue
            step = best[:, None] + model.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + model.emit[:, c]
        if n:
            label = [int(best.argmax())]
            for b in reversed(back):
                label.insert(0, int(b[label[0]]))
            assert got[at : at + n].tolist() == label
        at += n


def test_line_numbers_and_unicode_spaces():
    s = Q.line_statistics(["a b\n\n  c　d\r\n12", "", "y"], np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert list(zip(s["row"], s["line_no"], s["words"])) == [(0, 1, 2), (0, 3, 2), (2, 1, 1)]


@pytest.mark.parametrize("text", ["12", "— 7 —", "[3]", "Page 4", "xii", "12 / 80", "p. 9"])
def test_page_numbers_are_no_lines(text):
    assert len(Q.line_statistics([text], np.zeros(0, np.int64), np.zeros(0, np.int64))["row"]) == 0
