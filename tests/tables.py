"""Where the driver's smallest tables are."""

SF = "/root/testdata/sf0.001"
