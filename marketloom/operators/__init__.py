"""DataFrame operators over baskets, itemset supports, rules and runs."""
