"""Observation plans: raw tool output -> validated observations -> assets, edges, states, changes, events.

Each plan is one lazily built set of DataFrames.  What several of them share can be written once with ``stage`` (see
``plans.base.staged``); without it Spark recomputes the shared part for every output that is used.
"""
