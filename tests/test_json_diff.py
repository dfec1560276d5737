"""The path-wise JSON difference against plain Python on random nested documents."""

import json
import random
import re
from decimal import Decimal

from ledgerloom.operators.json_diff import json_diff

GONE = object()


def _plain(old, new, path="$", top=True):
    kind = lambda v: "{" if isinstance(v, dict) else "[" if isinstance(v, list) else "s"
    if top and old is GONE and kind(new) != "s" and new:
        old = type(new)()
    if top and new is GONE and kind(old) != "s" and old:
        new = type(old)()
    if old is not GONE and new is not GONE and kind(old) == kind(new) != "s":
        if kind(old) == "{":
            for k in old.keys() | new.keys():
                step = f".{k}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
                yield from _plain(old.get(k, GONE), new.get(k, GONE), path + step, False)
        else:
            for i in range(max(len(old), len(new))):
                yield from _plain(old[i] if i < len(old) else GONE, new[i] if i < len(new) else GONE, f"{path}[{i}]", False)
        return
    number = lambda v: isinstance(v, (int, Decimal, float)) and not isinstance(v, bool)
    if old is GONE or new is GONE or kind(old) != kind(new):
        same = old is new
    elif number(old) and number(new):
        same = float(old) == float(new) if float in (type(old), type(new)) else old == new
    else:
        same = type(old) is type(new) and old == new
    if not same:
        yield path, "added" if old is GONE else "removed" if new is GONE else "changed"


def _number(text):
    return float(text) if "e" in text.lower() else Decimal(text)


def _read(text):
    return GONE if text is None else json.loads(text, parse_float=_number)


def _doc(rng, depth=0):
    r = rng.random()
    if depth < 4 and r < 0.35:
        return "{" + ",".join(f"{json.dumps(k)}:{_doc(rng, depth + 1)}" for k in rng.sample(["a", "b", "c d", "e'f", "g.h", "q\\"], rng.randrange(4))) + "}"
    if depth < 4 and r < 0.55:
        return "[" + " , ".join(_doc(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    return rng.choice(["1", "1.0", "1e0", "10E-1", "2", "0.5", "5e-1", '"1"', '"x"', '""', "true", "false", "null", "12345678901234567890.5", "-0.25"])


def test_json_diff_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, _doc(rng) if rng.random() < 0.95 else None, _doc(rng) if rng.random() < 0.95 else None) for i in range(400)]
    for i in range(400, 800):                                # near pairs, so that differences lie deep
        kids = [_doc(rng, 1) for _ in range(4)]
        other = list(kids)
        other[rng.randrange(4)] = _doc(rng, 1)
        rows.append((i, "{" + ",".join(f'"k{j}":{v}' for j, v in enumerate(kids)) + "}",
                     "{" + ",".join(f'"k{j}":{other[j]}' for j in (3, 1, 0, 2)) + "}"))
    got = json_diff(spark.createDataFrame(rows, "path long, old string, new string"), "old", "new", []).count()
    frame = spark.createDataFrame(rows, "row long, old string, new string")
    found = sorted((r.row, r.path, r.change) for r in json_diff(frame, "old", "new", ["row"]).collect())
    want = sorted((i, *d) for i, o, n in rows for d in _plain(_read(o), _read(n)))
    assert found == want and got == len(want)


def test_json_diff_of_odd_texts(spark):
    rows = [(1, "broken", "{}"), (2, '{"a":1,"a":2}', '{"a":1}'), (3, None, '{"a":{"b":1}}'), (4, '{"a":1}', None), (5, None, None),
            (6, '{"b":2, "a":1.00}', '{"a":1,"b":2e0}'), (7, None, "{}"), (8, "[]", "{}"), (9, "broken", "broken"), (9, "1", "2"), (9, "1", "2"),
            (10, '{"a":{"b":[1,{"c":null}]}}', '{"a":{"b":[1,{"c":0}, "z"]}}')]
    got = sorted((r.id, r.path, r.change, r.old_value, r.new_value) for r in json_diff(
        spark.createDataFrame(rows, "id long, old string, new string"), "old", "new", ["id"]).collect())
    key = lambda r: tuple(x or "" for x in map(str, r))
    assert sorted(got, key=key) == sorted([
        (1, "$", "unparsed", "broken", "{}"), (2, "$", "unparsed", '{"a":1,"a":2}', '{"a":1}'), (3, "$.a", "added", None, '{"b":1}'),
        (4, "$.a", "removed", "1", None), (7, "$", "added", None, "{}"), (8, "$", "changed", "[]", "{}"), (9, "$", "changed", "1", "2"),
        (9, "$", "changed", "1", "2"), (10, "$.a.b[1].c", "changed", "null", "0"), (10, "$.a.b[2]", "added", None, '"z"')], key=key)
    assert json_diff(spark.createDataFrame([], "id long, old string, new string"), "old", "new", ["id"]).count() == 0
