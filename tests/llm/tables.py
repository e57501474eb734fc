SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
