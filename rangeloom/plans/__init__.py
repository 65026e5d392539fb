"""Query plans over the shared tables."""


def register_all(register) -> None:
    from rangeloom.plans import attribution_queries, catalog_queries, expansion_queries, history_queries, insight_queries, interval_queries, ipv6_queries, lineage_queries, pair_queries, record_queries, step_queries, text_queries

    for module in (interval_queries, attribution_queries, history_queries, catalog_queries, insight_queries, ipv6_queries, text_queries, lineage_queries, pair_queries, record_queries, step_queries, expansion_queries):
        module.register_all(register)
