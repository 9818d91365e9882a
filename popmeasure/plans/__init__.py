"""Study plans: the operators composed as the analyses use them."""
