"""The registry of hypotheses (YAML): what may be tested must be written down before."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("id", "signal", "params", "horizons_bars", "universe", "prediction", "mechanism", "status")


def load(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return check(yaml.safe_load(f))


def check(document: dict[str, Any]) -> dict[str, Any]:
    entries = (document or {}).get("hypotheses")
    if not entries:
        raise ValueError("the registry has no hypotheses")
    seen = set()
    for e in entries:
        if missing := [k for k in REQUIRED if k not in e]:
            raise ValueError(f"{e.get('id', '?')} lacks {missing}")
        if e["id"] in seen:
            raise ValueError(f"{e['id']} is there twice")
        seen.add(e["id"])
    tests = sum(len(e["horizons_bars"]) for e in entries)
    if (budget := document.get("budget")) is not None and tests > budget:
        raise ValueError(f"{tests} tests are more than the budget of {budget}")
    return document


def table(spark: SparkSession, document: dict[str, Any]) -> DataFrame:
    """id, signal, params, prediction and horizon: one row for each test."""
    rows = [(e["id"], e["signal"], {k: float(v) for k, v in e["params"].items()}, str(e["prediction"]), int(h)) for e in document["hypotheses"] for h in e["horizons_bars"]]
    return spark.createDataFrame(rows, "id string, signal string, params map<string,double>, prediction string, horizon int")


def require(document: dict[str, Any], signal: str, horizon: int, params: dict[str, Any] | None = None) -> dict[str, Any]:
    """The entry of a test; a test that isn't registered with these parameters is refused."""
    for e in document["hypotheses"]:
        if e["signal"] == signal and horizon in e["horizons_bars"] and (params is None or dict(params) == dict(e["params"])):
            return e
    raise ValueError(f"{signal} at {horizon} bars isn't registered{'' if params is None else ' with these parameters'}")


def budget_remaining(document: dict[str, Any]) -> dict[str, int]:
    used = sum(len(e["horizons_bars"]) for e in document["hypotheses"])
    budget = int(document.get("budget", used))
    return {"budget": budget, "registered": used, "remaining": budget - used}


def verdicts(document: dict[str, Any], results: list[dict[str, Any]], alpha: float = 0.05) -> dict[str, str]:
    """What each tested hypothesis's adjusted p-values say about its registered direction."""
    out = {}
    for e in document["hypotheses"]:
        own = [r for r in results if r["hypothesis_id"] == e["id"]]
        if not own:
            continue
        text = str(e["prediction"]).lower()
        null = any(p in text for p in ("indistinguishable from zero", "= 0 within", "= 0 by construction"))
        claim = "null" if null else "non_positive" if "<= 0" in text else "positive" if "ic > " in text or "> 0" in text else "null"
        found = sorted((r for r in own if r.get("p_value_by") is not None and r["p_value_by"] < alpha), key=lambda r: r["p_value_by"])
        if not found:
            out[e["id"]] = "held" if claim == "null" else "falsified: nothing is significant"
        elif claim == "null":
            out[e["id"]] = "falsified: registered as null, something is significant"
        else:
            right = (found[0]["ic"] > 0) == (claim == "positive")
            out[e["id"]] = "supported in sign" if right else "falsified: the sign is reversed"
    return out


def mark(document: dict[str, Any], verdicts_: dict[str, str], path: str | None = None) -> dict[str, Any]:
    """The document with new statuses; written to path, if one is given."""
    for e in document["hypotheses"]:
        e["status"] = verdicts_.get(e["id"], e["status"])
    if path:
        import yaml

        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(document, f, sort_keys=False)
    return document
