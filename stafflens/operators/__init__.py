"""DataFrame → DataFrame operators.

rates      W09–W11, W13, W18, W21 (+ event_rate)   group rates, shares, gaps
stats      W16, W17, W19, W20, W26, W27 (+ moments) profiles, percentiles, top-k, correlation
trends     W14, W15, W24, W25, W29                  rolling trends, cohorts, lag, first/last, timelines
ranking    W05, W22, W23                            dense keys, rank within, global NTILE
scoring    W30–W33                                  as-of snapshots, scorecards, confusion
hierarchy  W28                                      tree depth by frontier join
warehouse  W04, W06–W08                             dimensions, time dimension, constraints, facts
joins                                               size-checked broadcast, salted join
"""
