"""Patches find their definition, or say why not."""

from graphloom.operators.patching import apply, insert_note

SOURCE = '''class A:
    def load(self):
        """Doc."""
        return 1

class B:
    def load(self):
        return 2

def one(): pass

def last():
    return 3'''


def test_places():
    text, error = insert_note(SOURCE, "load", "m::A::load", 0, 0, ["note"])
    assert not error and text.index("# note") > text.index('"""Doc."""') and text.index("# note") < text.index("class B")
    text, _ = insert_note(SOURCE, "load", "", 6, 8, ["note"])
    assert "        # note\n        return 2" in text
    text, _ = insert_note(SOURCE, "last", "last", 90, 99, ["a", "b"])
    assert text.endswith("def last():\n    # a\n    # b\n    return 3")
    assert insert_note(SOURCE, "load", "", 0, 0, ["n"]) == (None, "2 definitions of load: A::load at 2, B::load at 7")
    assert insert_note(SOURCE, "none", "", 0, 0, ["n"])[0] is None and insert_note(SOURCE, "one", "", 0, 0, ["n"])[0] is None
    assert insert_note("def (", "x", "", 0, 0, ["n"])[0] is None


def test_in_bulk(spark):
    rows = [("p1", "a.py", SOURCE, "last", "last", None, None, "do it"), ("p2", "b.py", None, "x", None, 0, 0, None)]
    out = {r.patch_id: r for r in apply(spark.createDataFrame(rows, "patch_id string, path string, text string, name string, qualified_name string, start int, stop int, intent string")).collect()}
    assert "# TODO [p1]: do it" in out["p1"].text and out["p2"].error
