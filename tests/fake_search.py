"""A client for the search source: 250 results, and a query that fails."""


def client(query, sort, first, size):
    if query == "down":
        raise OSError("no connection")
    assert size <= 100
    rows = [{"arxiv_id": f"{i:04d}", "title": query, "comment": sort} for i in range(250)]
    if sort.endswith("descending"):
        rows.reverse()
    return rows[first : first + size]
