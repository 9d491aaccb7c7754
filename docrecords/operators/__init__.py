"""DataFrame operators over pages, nodes, records, links and URL rules."""
