"""Small graphs with known answers, as pandas tables or as data frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NODE = "graph_id string, node string, node_idx int, type string"
EDGE = "graph_id string, src string, dst string, edge_idx int, relation string, weight double"


def tables(types: dict[str, str], links: list[tuple[str, str]], graph_id: str = "g") -> tuple[pd.DataFrame, pd.DataFrame]:
    n = pd.DataFrame([(graph_id, k, i, t) for i, (k, t) in enumerate(types.items())], columns=["graph_id", "node", "node_idx", "type"])
    e = pd.DataFrame([(graph_id, a, b, i, "link", 1.0) for i, (a, b) in enumerate(links)], columns=["graph_id", "src", "dst", "edge_idx", "relation", "weight"])
    return n, e


def plain(n: int, links: list[tuple[int, int]], graph_id: str = "g"):
    return tables({str(k): "unknown" for k in range(n)}, [(str(a), str(b)) for a, b in links], graph_id)


def archetypes(max_size: int = 6) -> Iterator[tuple[str, int, pd.DataFrame, pd.DataFrame]]:
    """Campaigns of 2 to ``max_size`` domains that share a server, a certificate, or a certificate and an icon."""
    hubs = {"shared_ip_star": [("ip_shared", "ip")], "shared_cert_star": [("cert_shared", "cert_peer")], "dense_multi_signal": [("cert_shared", "cert_peer"), ("favicon_shared", "favicon")]}
    for name, shared in hubs.items():
        for size in range(2, max_size + 1):
            domains = [f"domain{k}" for k in range(size)]
            yield name, size, *tables({d: "domain" for d in domains} | dict(shared), [(d, h) for d in domains for h, _ in shared], f"{name}_{size}")


def demo() -> tuple[pd.DataFrame, pd.DataFrame]:
    """A campaign of 19 nodes and 26 links; links are numbered as they are met node by node."""
    p = [f"phish{k}.xyz" for k in range(5)]
    a, b = "185.220.101.47", "185.220.101.48"
    types = {x: "domain" for x in p} | {a: "ip", b: "ip", "wildcard_cert": "cert_peer", "separate_cert": "cert_peer", "NameCheap": "registrar", "Porkbun": "registrar", "favicon:a1b2c3": "favicon", "AS44477|Stark": "asn"}
    types |= {"Frankfurt|DE": "geo", "Amsterdam|NL": "geo", "legit1.com": "co_host", "legit2.com": "co_host", "legit3.org": "co_host", "admin.phish0.xyz": "subdomain"}
    links = [(x, a) for x in p[:3]] + [(x, b) for x in p[3:]] + [(x, "wildcard_cert") for x in p[:4]] + [(p[4], "separate_cert")]
    links += [(x, "NameCheap") for x in p[:3]] + [(x, "Porkbun") for x in p[3:]] + [(x, "favicon:a1b2c3") for x in p[:3]]
    links += [(a, "AS44477|Stark"), (b, "AS44477|Stark"), (a, "Frankfurt|DE"), (b, "Amsterdam|NL"), (a, "legit1.com"), (b, "legit2.com"), (a, "legit3.org"), (p[0], "admin.phish0.xyz")]
    at = {n: k for k, n in enumerate(types)}
    met = sorted(links, key=lambda e: min(at[e[0]], at[e[1]]))  # stable: a node's links stay in order
    return tables(types, met, "demo")


def synthetic_suite() -> list[tuple[str, tuple, tuple]]:
    ring = plain(6, [(k, (k + 1) % 6) for k in range(6)], "C6")
    triangles = plain(6, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)], "2C3")
    star = plain(9, [(0, k) for k in range(1, 9)], "star8")
    double = plain(10, [(0, 5)] + [(0, k) for k in range(1, 5)] + [(5, k) for k in range(6, 10)], "dstar")
    campaign = lambda hub, kind, own, own_kind, name: tables({**{f"d{k}": "domain" for k in range(3)}, hub: kind, **{f"{own}{k}": own_kind for k in range(3)}}, [(f"d{k}", hub) for k in range(3)] + [(f"d{k}", f"{own}{k}") for k in range(3)], name)
    return [("rings", ring, triangles), ("stars", star, double), ("campaigns", campaign("ip", "ip", "cert", "cert_peer", "camp_ip"), campaign("cert", "cert_peer", "ip", "ip", "camp_cert"))]


def frames(spark: SparkSession, graphs: list[tuple[pd.DataFrame, pd.DataFrame]]) -> tuple[DataFrame, DataFrame]:
    n, e = pd.concat([g[0] for g in graphs]), pd.concat([g[1] for g in graphs])
    return spark.createDataFrame(list(n.itertuples(index=False, name=None)), NODE), spark.createDataFrame(list(e.itertuples(index=False, name=None)), EDGE)
