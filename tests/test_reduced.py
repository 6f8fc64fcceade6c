"""Reduced forms of operators are named as such."""

from pathlib import Path

from leafmill.plans import catalog


def test_reduced_forms_are_named():
    readme = (Path(__file__).resolve().parents[1] / "README.md").read_text()
    reduced = [name for name, plan in catalog.plans().items() if "Reduced:" in plan.doc]
    assert reduced
    for name in reduced:
        assert name[:3].upper() + " (" in readme
