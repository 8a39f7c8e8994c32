from compare import difference

from trackloom.llm import perspectives, queries


def test_query_equals_sql(spark, duck, sf_dir):
    assert difference(queries.op8_perspectives(spark, sf_dir), duck, queries.SQL["op8_perspectives"]) is None


def plain(turns):
    """Whole renderings by conversation and perspective, with the marked texts."""
    out = {}
    for conv in {c for c, *_ in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown", t[3] or ""))
        for who in {t[2] or "unknown" for t in mine} - {"system"}:
            text, marked = "", []
            for _, _, role, said in mine:
                role = role or "unknown"
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user:{role}|>\n"
                if role == who:
                    marked.append(said or "")
                text += (said or "") + "\n"
            out[conv, who] = (text, marked)
    return out


def test_parts_make_up_whole_renderings(spark):
    turns = [(1, i % 40, ("ann", "bob", "eve")[i % 3], f"says {i}") for i in range(120)]
    turns += [(2, 0, "system", "be kind"), (2, 1, "user", "é😀 hi"), (2, 1, "user", "é😀 hi"), (2, None, None, None), (3, 0, "system", "alone"), (None, 0, "user", "x")]
    frame = spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id long, turn long, role string, text string, perspective string, start int")
    found = {}
    for r in sorted(perspectives.render(frame, part_chars=100).collect(), key=lambda r: r.start):
        text, marked = found.setdefault((r.conv_id, r.perspective), ["", []])
        assert r.start == len(text) and len(r.text) < 250
        found[r.conv_id, r.perspective][0] += r.text
        for span in filter(None, r.mask.split(",")):
            a, b = map(int, span.split(":"))
            marked.append(r.text[a:b])
    assert {k: tuple(v) for k, v in found.items()} == plain(turns)
    assert perspectives.render(frame.limit(0)).count() == 0
