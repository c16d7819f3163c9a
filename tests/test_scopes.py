"""Name resolution over nested scopes: one alias for different tables, correlated names, derived tables, CTEs."""

import random

from nlsql_spark.operators.scopes import resolve_scoped_columns

SCOPES = "question_id long, scope_id int, parent_id int"
BINDINGS = "question_id long, database_name string, scope_id int, name string, alias string, inner_scope int"
OUTPUTS = "question_id long, scope_id int, output_name string, qualifier string, column_name string"
COLUMNS = "question_id long, scope_id int, qualifier string, column_name string"


def resolved(spark, catalog, scopes, bindings, outputs, columns):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((scopes, SCOPES), (bindings, BINDINGS), (outputs, OUTPUTS), (columns, COLUMNS))]
    out = resolve_scoped_columns(*frames, catalog)
    return sorted((r["question_id"], r["scope_id"], r["qualifier"], r["column_name"], r["table_name"], r["source_column"]) for r in out.collect())


def test_scopes(spark, make_catalog):
    catalog = make_catalog({"person": ["id", "name", "age"], "pet": ["id", "owner", "kind"], "city": ["name", "size"]})
    # SELECT d.n, kind FROM (SELECT x.name AS n, x.id AS i FROM person x) d, pet x
    #   WHERE EXISTS (SELECT 1 FROM city x WHERE x.name = d.n AND size > 3 AND kind = '' AND x.age = 0 AND nothing = 1)
    scopes = [(1, 0, None), (1, 1, 0), (1, 2, 0)]
    bindings = [(1, "db", 0, "d", "", 1), (1, "db", 0, "pet", "x", None), (1, "db", 1, "person", "x", None), (1, "db", 2, "City", "X", None)]
    outputs = [(1, 1, "n", "x", "name"), (1, 1, "i", "x", "id")]
    columns = [(1, 0, "d", "N"), (1, 0, "", "kind"), (1, 0, "x", "id"), (1, 1, "x", "name"), (1, 2, "x", "name"), (1, 2, "d", "n"), (1, 2, "", "size"), (1, 2, "", "kind"), (1, 2, "x", "age"), (1, 2, "", "nothing")]
    # a CTE over a CTE, used twice in another question; an unqualified column found in two tables
    scopes += [(2, 0, None), (2, 1, 0), (2, 2, 0)]
    bindings += [(2, "db", 0, "second", "s", 2), (2, "db", 1, "person", "", None), (2, "db", 2, "first", "", 1), (2, "db", 0, "city", "", None), (2, "db", 0, "person", "p", None)]
    outputs += [(2, 1, "years", "person", "age"), (2, 2, "y", "first", "years"), (2, 2, "z", "", "years")]
    columns += [(2, 0, "s", "y"), (2, 0, "second", "z"), (2, 2, "", "years"), (2, 0, "", "name"), (2, 0, "gone", "name")]
    assert resolved(spark, catalog, scopes, bindings, outputs, columns) == sorted([
        (1, 0, "d", "N", "person", "name"), (1, 0, "", "kind", "pet", "kind"), (1, 0, "x", "id", "pet", "id"), (1, 1, "x", "name", "person", "name"),
        (1, 2, "x", "name", "city", "name"), (1, 2, "d", "n", "person", "name"), (1, 2, "", "size", "city", "size"), (1, 2, "", "kind", "pet", "kind"),
        (1, 2, "x", "age", "city", "age"),
        (2, 0, "s", "y", "person", "age"), (2, 0, "second", "z", "person", "age"), (2, 2, "", "years", "person", "age"),
        (2, 0, "", "name", "city", "name"), (2, 0, "", "name", "person", "name"),
    ])
    assert resolved(spark, catalog, [], [], [], []) == []


def plain(catalog, scopes, bindings, outputs, columns):
    """The same, name by name."""
    parent = {(q, s): p for q, s, p in scopes}

    def ends(q, s, qual, col):
        while s is not None:
            own = [b for b in bindings if (b[0], b[2]) == (q, s)]
            fits = [b for b in own if not qual or qual in (b[3].lower(), (b[4] or b[3]).lower())]
            got = set()
            for b in fits:
                if b[5] is None:
                    if col in catalog[b[3]]:
                        got.add((b[3], col))
                else:
                    for o in outputs:
                        if (o[0], o[1], o[2]) == (q, b[5], col):
                            got.add(("next", b[5], o[3], o[4]))
            if got:
                return {e for g in got for e in (ends(q, *g[1:]) if g[0] == "next" else {g})}
            if qual and fits:
                return {(b[3], col) for b in fits if b[5] is None}
            s = parent[q, s]
        return set()

    return sorted({(q, s, qual, col, *e) for q, s, qual, col in columns for e in ends(q, s, qual, col)})


def test_random_scopes(spark, make_catalog):
    rng = random.Random(2)
    tables = {f"t{i}": rng.sample("abcdefgh", 4) for i in range(5)}
    scopes, bindings, outputs, columns = [], [], [], []
    for q in range(60):
        n = rng.randint(1, 6)
        scopes += [(q, s, None if s == 0 else rng.randrange(s)) for s in range(n)]
        for s in range(n):
            for k in range(rng.randint(1, 3)):
                # the result of a later scope, so that no name goes round in circles inwards
                inner = rng.randrange(s + 1, n) if s + 1 < n and rng.random() < 0.4 else None
                name = f"d{k}" if inner is not None else rng.choice(list(tables))
                bindings.append((q, "db", s, name, rng.choice(["", "x", "y"]), inner))
            for o in range(2):
                outputs.append((q, s, f"o{o}", "", rng.choice("abcdefgh")))
            columns += [(q, s, rng.choice(["", "", "x", "y", "t1", "d0"]), rng.choice([*"abcdefgh", "o0", "o1"])) for _ in range(6)]
    want = plain(tables, scopes, bindings, outputs, columns)
    assert len(want) > 300
    assert resolved(spark, make_catalog(tables), scopes, bindings, outputs, columns) == want


def test_wide_tables_are_not_copied(spark, make_catalog, monkeypatch):
    """A stored step holds what was asked, not every column of every table that a question binds."""
    import nlsql_spark.operators.scopes as S

    most, keep = [], S.materialize

    def counted(df):
        out = keep(df)
        most.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(S, "materialize", counted)
    catalog = make_catalog({"wide": [f"c{i}" for i in range(500)]})
    questions = range(20)
    scopes = [(q, 0, None) for q in questions]
    bindings = [(q, "db", 0, "wide", "w", None) for q in questions]
    columns = [(q, 0, "w", f"C{q}") for q in questions]
    assert resolved(spark, catalog, scopes, bindings, [], columns) == [(q, 0, "w", f"C{q}", "wide", f"c{q}") for q in questions]
    assert max(n for names, n in most if "question_id" in names) == 20
