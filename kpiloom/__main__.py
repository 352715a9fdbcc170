from kpiloom.jobs import main

main()
