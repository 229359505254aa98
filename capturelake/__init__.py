"""Fleet-scale colour-calibrated field tests and tamper-evident record logs on Spark."""
