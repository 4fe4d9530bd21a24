from signetry.operators import laplacian
from signetry.plans import measures

SF = "/root/testdata/sf0.001"


def test_solvers_are_compared_some_axes_at_a_time(spark, monkeypatch):
    """The driver never solves more numbers at once than its blocks have, though the coordinates have more."""
    network = measures.QUERIES["network_solver_residual"]
    n = network.__wrapped__.__globals__["rating_graph"](spark, SF).selectExpr("explode(array(source, target)) as x").distinct().count()
    sizes = []
    for name in ("_conjugate", "held_values"):
        plain = getattr(laplacian, name)

        def watched(*args, plain=plain, name=name):
            out = plain(*args)
            sizes.append(out.shape[1])
            return out

        monkeypatch.setattr(laplacian, name, watched)
    monkeypatch.setattr(laplacian, "HELD", 3 * n)
    monkeypatch.setattr(laplacian, "AT_ONCE", n)
    assert {tuple(r) for r in network(spark, SF).collect()} == {("held", True), ("sent", True), ("table", True)}
    assert sizes and max(sizes) <= 3
