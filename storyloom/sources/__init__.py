"""Where articles come from: files of feeds, sitemaps and pages, and the tables that stand in for them."""
