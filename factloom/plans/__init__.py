"""Registered queries: name -> callable(spark, sf_dir), and the SQL that says the same."""
