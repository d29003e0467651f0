"""Food-product analytics as Spark jobs: classification ingest, browsing, and barcode reconciliation."""
