"""Late-corrected campaign KPIs as Spark jobs: raw zone, silver events, gold summary."""
