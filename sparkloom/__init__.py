"""sparkloom: vector search, drift statistics, log replay, content scans and traces as Spark jobs."""
