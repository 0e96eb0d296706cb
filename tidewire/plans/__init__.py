"""Table layouts, reports, dashboards and the registered queries."""
