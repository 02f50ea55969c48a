"""A small graph: three people, three modules, a technology, a decision."""

ENT = "id string, type string, name string, aliases array<string>, description string, first_seen string, last_seen string, frequency long, embedding array<float>"
REL = "id string, type string, source_id string, target_id string, weight double, first_seen string, last_seen string"
UNIT = "id string, content string, date_end string, entity_ids array<string>"
COMM = "id string, level int, title string, summary string, entity_ids array<string>, embedding array<float>"


def graph(spark):
    e = lambda i, t, n, f, d, v: (i, t, n, [], d, "2024-01-01", "2024-06-01", f, v and [float(x) for x in v])
    entities = [
        e("p:ann", "PERSON", "Ann", 5, "writes payments", [1.0, 0, 0, 0]), e("p:bob", "PERSON", "Bob", 3, "", [0, 1.0, 0, 0]), e("p:cy", "PERSON", "Cy", 1, "", [0, 0, 1.0, 0]),
        e("m:pay", "MODULE", "src/pay", 10, "payment gateway", [0.9, 0.1, 0, 0]), e("m:pay/api", "MODULE", "src/pay/api", 4, "", [0.5, 0.5, 0, 0]), e("m:ui", "MODULE", "src/ui", 6, "screens", [0, 0, 0, 1.0]),
        e("t:sql", "TECHNOLOGY", "PostgreSQL", 2, "database of payments", None), e("d:move", "DECISION", "Move to PostgreSQL", 1, "payments moved", [0.7, 0, 0.7, 0]),
    ]
    r = lambda i, t, a, b, w, last="2024-06-01": (i, t, a, b, w, "2024-01-01", last)
    relations = [
        r("r1", "AUTHORED", "p:ann", "m:pay", 8.0), r("r2", "MODIFIED", "p:bob", "m:pay", 2.0, "2023-01-01"), r("r3", "AUTHORED", "p:bob", "m:pay/api", 3.0), r("r4", "AUTHORED", "p:ann", "m:ui", 1.0, "2020-01-01"),
        r("r5", "CO_CHANGED", "m:pay", "m:ui", 4.0), r("r6", "CO_CHANGED", "m:ui", "m:pay/api", 1.0), r("r7", "USES", "m:pay", "t:sql", 5.0), r("r8", "DECIDED", "p:ann", "d:move", 6.0), r("r9", "CO_CHANGED", "m:pay", "m:pay/api", 9.0),
    ]
    units = [("u1", "[aaaaaaa] 2024-01-01 Ann\npay", "2024-01-01", ["p:ann", "m:pay"]), ("u2", "x" * 400, "2024-05-01", ["p:ann"]), ("u3", "short", "2024-03-01", ["m:pay", "t:sql"])]
    communities = [("c0", 0, "Payments", "gateway and database", ["p:ann", "m:pay", "m:pay/api", "t:sql"], [1.0, 0.0, 0.0, 0.0]), ("c1", 0, "Interface", "screens", ["m:ui"], [0.0, 0.0, 0.0, 1.0]), ("c2", 1, "All of it", "payments and screens", ["p:ann", "m:pay", "m:ui"], None)]
    return spark.createDataFrame(entities, ENT), spark.createDataFrame(relations, REL), spark.createDataFrame(units, UNIT), spark.createDataFrame(communities, COMM)
