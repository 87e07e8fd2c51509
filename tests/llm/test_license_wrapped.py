"""Licence notices that run over line ends."""

from weftlist.llm import license_scan


def test_wrapped_notices(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    free = "Permission is hereby granted free of charge to any person obtaining a copy of this software"
    texts = [
        "This work is licensed under the GNU\nGeneral Public License, version 3.",
        "\n".join(gpl.split()),
        "\n".join(f"# {x}" for x in ("intro", "Permission is hereby granted", "free of charge to any", "person obtaining a copy", "of this software")),
        "This work is licensed under the GNX\nGeneral Public License, version 3.",
        "This work is licensed under the GNU\n\nGeneral Public License, version 3.",
        f"a b\n{gpl}\nc d\n{free}\ne f",
        "of the\nin the\nto a\n",
    ]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].families for i in range(7)] == [["gpl-3.0"], ["gpl-3.0"], ["mit"], ["gpl-3.0"], [], ["gpl-3.0", "mit"], []]
    assert [(x.line, x.family) for x in rows[5].notices] == [(1, "gpl-3.0"), (3, "mit")]
    assert [sum(x.confirmed for x in rows[i].notices) for i in (0, 2, 3)] == [1, 1, 1]
