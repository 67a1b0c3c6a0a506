"""Every query of the reference's operators: name to function, and name to SQL where there is one."""

from __future__ import annotations

from plausia.plans import answers, assembly, dimensions, evaluation, ranking, requests, texts, threads, timed, understanding

ALL = {k: v for m in (ranking, threads, texts, dimensions, evaluation, timed, answers, requests, understanding, assembly) for k, v in m.QUERIES.items()}
QUERIES = {k: f for k, (f, _) in ALL.items()}
ORACLES = {k: s for k, (_, s) in ALL.items() if s}
